"""URL filter by rules, then by a character language-model ratio. DataFrame code only.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each URL a
log-likelihood difference per character; a threshold calibrated on held-out labelled URLs decides.

Model. For a character ``c`` after a context of ``k`` characters, ``p_k = (n(ctx c) + m * p_(k-1)) / (n(ctx) + m)``
with ``p_-1 = 1 / alphabet``: the order in use is the longest context that was seen. All labelled URLs train the
model, minus the hash-chosen ones that calibrate it; counts are pre-aggregated before their shuffle. Log ratios are
kept as whole micro-nats, so sums do not depend on the order of rows.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule; an empty host and path is
allowed by the method (no evidence); without labelled URLs of both kinds the method allows everything; repeated URLs
count as often as they occur; extra columns of the input are left alone. Model columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm._common import cut, lower_ascii

MAX_RULES = 1000
#: Above this number of grams the model is joined by shuffle instead of broadcast (a gram takes under 100 bytes).
BROADCAST_GRAMS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, by the contract's definition."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits. A rule is (action, ``host/path``)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into the plan")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame, col: str, order: int, keep: list[str]) -> DataFrame:
    """One row per character (and the end): ``g``, the last ``order + 1`` characters."""
    chars = F.concat(F.array_repeat(F.lit("\u0002"), order), F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0)), F.array(F.lit("\u0003")))
    at = df.select(*keep, chars.alias("_c"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_c") - order), lambda i: F.array_join(F.slice("_c", i, order + 1), ""))
    return at.select(*keep, F.explode_outer(grams).alias("g"))  # a plain explode filters on the array's size and computes it twice


def train(urls: DataFrame, text: str = "text", label: str = "accepted", order: int = 3, mass: float = 2.0, alphabet: int = 128) -> DataFrame:
    """Model table ``(kind, k, key, v)`` from labelled URLs that each occur ``n`` times.

    Kind ``g``: micro-nats that a gram adds as the longest one seen, less the back-off of its own context; kind
    ``c``: micro-nats of back-off, summed over a context and its suffixes. A character's log ratio is the ``g`` of
    the longest seen gram ending in it plus the ``c`` of the longest seen context before it.
    """
    g = _grams(urls.select(text, label, "n"), text, order, [label, "n"])
    yes, no = F.sum(F.when(F.col(label), F.col("n")).otherwise(0)), F.sum(F.when(F.col(label), 0).otherwise(F.col("n")))
    whole = g.groupBy("g", label).agg(F.sum("n").alias("n"))
    suffixes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.struct(k.alias("k"), F.substr("g", order + 1 - k).alias("gram"))))
    counts = cut(whole.select(suffixes.alias("s"), label, "n").groupBy("s.k", "s.gram").agg(yes.alias("ny"), no.alias("nn")))
    ctx = counts.groupBy("k", F.expr("substring(gram, 1, k)").alias("ctx")).agg(F.sum("ny").alias("cy"), F.sum("nn").alias("cn"))
    # Log back-off weights of contexts, summed from the shortest: join each context to its suffix, order by order.
    log = lambda c: F.log(F.lit(mass) / (F.col(c) + mass))
    ctx = cut(ctx.withColumn("own", F.round((log("cy") - log("cn")) * 1e6).cast("long")))
    level = ctx.filter("k = 0").select("k", "ctx", "cy", "cn", F.col("own").alias("b"))
    totals = level.select("cy", "cn", "b").first()  # the empty context: one row
    first = lambda n, c: (F.col(n) + mass / alphabet) / F.lit(float(totals[c] + mass))
    probs = counts.filter("k = 0").select("gram", first("ny", "cy").alias("py"), first("nn", "cn").alias("pn"), F.lit(int(totals["b"])).cast("long").alias("b"))
    grams, backs = [probs.withColumn("k", F.lit(0))], [level.select("k", "ctx", "b")]
    for k in range(1, order + 1):
        prev_b = backs[-1].select(F.col("ctx").alias("suf"), F.col("b").alias("b0"))
        level = ctx.filter(f"k = {k}").withColumn("suf", F.expr("substring(ctx, 2)"))
        level = level.join(prev_b, "suf", "left").withColumn("b", F.col("own") + F.coalesce("b0", F.lit(0)))
        prev = grams[-1].select(F.col("gram").alias("suf"), F.col("py").alias("qy"), F.col("pn").alias("qn"))
        step = lambda n, q, c: (F.col(n) + mass * F.col(q)) / (F.col(c) + mass)
        rows = counts.filter(f"k = {k}").withColumn("suf", F.expr("substring(gram, 2)")).withColumn("ctx", F.expr(f"substring(gram, 1, {k})"))
        rows = rows.join(prev, "suf").join(level.select("ctx", "cy", "cn", "b"), "ctx")
        grams.append(cut(rows.select("gram", step("ny", "qy", "cy").alias("py"), step("nn", "qn", "cn").alias("pn"), "b", F.lit(k).alias("k"))))
        backs.append(cut(level.select("k", "ctx", "b")))
    table = None
    for part in grams:
        e = F.round((F.log("py") - F.log("pn")) * 1e6).cast("long") - F.col("b")
        rows = part.select(F.lit("g").alias("kind"), "k", F.col("gram").alias("key"), e.alias("v"))
        table = rows if table is None else table.union(rows)
    for part in backs:
        table = table.union(part.select(F.lit("c").alias("kind"), "k", F.col("ctx").alias("key"), F.col("b").alias("v")))
    return cut(table)


def score(urls: DataFrame, model: DataFrame, text: str = "text", order: int = 3, alphabet: int = 128) -> DataFrame:
    """``(text, micro, chars)`` of the distinct texts: their summed log ratio in micro-nats and their length + 1."""
    g = _grams(urls.select(text).distinct(), text, order, [text])
    small = model.count() <= BROADCAST_GRAMS  # a checked size; beyond it the joins shuffle
    e = b = None
    for k in range(order, -1, -1):
        for kind in "gc":
            side = model.filter(f"kind = '{kind}' and k = {k}").select(F.col("key").alias(f"_{kind}{k}"), F.col("v").alias(f"{kind}{k}"))
            key = F.expr(f"substring(g, {order + 1 - k}, {k + (kind == 'g')})")
            g = g.withColumn(f"_{kind}{k}", key).join(F.broadcast(side) if small else side, f"_{kind}{k}", "left")
    e = F.coalesce(*[F.col(f"g{k}") for k in range(order, -1, -1)], F.lit(0))
    b = F.coalesce(*[F.col(f"c{k}") for k in range(order, -1, -1)], F.lit(0))
    return g.groupBy(text).agg(F.sum(e + b).alias("micro"), F.count("*").alias("chars"))


def calibrate(scored: DataFrame, label: str = "accepted") -> int:
    """The bin (0.01 nats a character) from which URLs are accepted: the largest true minus false accept rate.

    Every labelled row counts; what reaches the driver is one row a bin. Ties take the bin nearest to zero, then
    the lower. Without rows of both kinds: 0.
    """
    binned = scored.select(_bin().alias("bin"), label, "n")
    rows = binned.groupBy("bin").agg(F.sum(F.when(F.col(label), F.col("n")).otherwise(0)), F.sum(F.when(F.col(label), 0).otherwise(F.col("n")))).collect()
    yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not yes or not no:
        return 0
    best = []
    for t in sorted({r[0] for r in rows} | {0}):
        a, f = sum(r[1] for r in rows if r[0] >= t), sum(r[2] for r in rows if r[0] >= t)
        best.append((f * yes - a * no, abs(t), t))
    return min(best)[2]


def _bin() -> Column:
    return F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("micro") / (F.col("chars") * 10000.0)))).cast("long")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: list[str] | None = None, order: int = 3) -> DataFrame:
    """Judge every row: columns ``keep`` plus host, path, rule and verdict (allow or block).

    The URLs that rules decide are the labelled ones: three sixteenths of them, by a hash of the text, calibrate the
    threshold and the others train the models.
    """
    host, path = split_url(F.col(url))
    parsed = pages.select(*[F.col(c) for c in (keep or [])], host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "_by_rule": verdict}).withColumn("_text", F.concat("host", "path"))
    labelled = cut(parsed.filter("rule is not null").groupBy(F.col("_text").alias("text"), (F.col("_by_rule") == "allow").alias("accepted")).agg(F.count("*").alias("n")))
    labelled = labelled.withColumn("_held", F.substring(F.md5("text"), 1, 1).isin("0", "1", "2"))
    both = labelled.filter("not _held").agg(F.sum(F.col("accepted").cast("int")), F.sum((~F.col("accepted")).cast("int"))).first()
    if not both[0] or not both[1]:
        return parsed.select(*(keep or []), "host", "path", "rule", F.coalesce("_by_rule", F.lit("allow")).alias("verdict"))
    model = train(labelled.filter("not _held"), order=order)
    held = labelled.filter("_held").select("text", "accepted", "n")
    threshold = calibrate(score(held, model, order=order).join(held, "text"))
    undecided = parsed.filter("rule is null and _text <> ''").select(F.col("_text").alias("text"))
    judged = score(undecided, model, order=order).select(F.col("text").alias("_text"), F.when(_bin() >= threshold, "allow").otherwise("block").alias("_by_model"))
    out = parsed.join(judged, "_text", "left")
    return out.select(*(keep or []), "host", "path", "rule", F.coalesce("_by_rule", "_by_model", F.lit("allow")).alias("verdict"))
