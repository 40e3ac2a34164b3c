"""URL filters, chat formatting, mixing, SimHash, quality, secrets and language ID against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm import _common, language_id, mixing, quality, queries, reply_trees, secrets, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, _text string"


def docs_of(spark, rows):
    """(id, text, lang, source); extra columns have names that operators use."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "x", "y") for i, t, la, s in rows], DOCS)


EDGE = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "some words here", None, "b"), (3, " \n\t ", "de", None), (4, "é" * 9000 + " " + "ab " * 20000, "fr", "b"), (5, "123 !!", "en", "a"), *[(6, "equal rows of one text", "en", "a")] * 3]


# --- op 1


def brute_rule(host, path, rules):
    best = None
    for action, rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "://", "http://EXAMPLE.com", "https://a.Example.com/en/7x?q#f", "http://b.com/en/", "http://bcom/en/", "x://net/de/", "http://example.net/de/8", "http://example.net/de/9?x=/en/", "http://q.org/es/1://z", "http://h?x/y", "http://h#x/y", "http://ex.com/en/" + "a" * 20000]
    frame = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(urls * 2)], "page_id long, url string, text string, n string")
    got = url_filter.filter_urls(frame, queries.URL_RULES, keep=["page_id"]).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        url = urls[r.page_id % len(urls)] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        authority = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in authority)
        path = re.match(r"[^?#]*", rest[len(authority) :])[0]
        want = brute_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (want[1] if want else None)
        assert r.verdict == want[0] if want else r.verdict in ("allow", "block")


def test_url_model_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("good" + "".join(rng.choices("abc", k=5)), True, 1) for _ in range(40)] + [("bad" + "".join(rng.choices("xyz", k=5)), False, 2) for _ in range(40)]
    rows = list(dict(((t, a), n) for t, a, n in rows).items())
    rows = [(t, a, n) for (t, a), n in rows]
    model = url_filter.train(spark.createDataFrame(rows, "text string, accepted boolean, n long"))
    tests = ["goodabcab", "badxyzxy", "neither", "", "gooxyz"]
    got = {r.text: (r.micro, r.chars) for r in url_filter.score(spark.createDataFrame([(t,) for t in tests], "text string"), model).collect()}

    counts = {True: Counter(), False: Counter()}
    for t, a, n in rows:
        s = "\x02" * 3 + t + "\x03"
        for i in range(3, len(s)):
            for k in range(4):
                counts[a][s[i - k : i + 1]] += n
    ctx = {a: Counter() for a in counts}
    for a, c in counts.items():
        for g, n in c.items():
            ctx[a][g[:-1], len(g)] += n

    def p(a, g):
        if not g:
            return 1 / 128
        return (counts[a][g] + 2 * p(a, g[1:])) / (ctx[a][g[:-1], len(g)] + 2)

    for t in tests:
        s = "\x02" * 3 + t + "\x03"
        want = sum(math.log(p(True, s[i - 3 : i + 1])) - math.log(p(False, s[i - 3 : i + 1])) for i in range(3, len(s)))
        assert got[t][1] == len(t) + 1
        assert got[t][0] / 1e6 == pytest.approx(want, abs=1e-4)


def test_url_filter_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "http://x.y/z")], "page_id long, url string")
    assert url_filter.filter_urls(frame, [], keep=["page_id"]).first().verdict == "allow"
    assert url_filter.filter_urls(frame.limit(0), queries.URL_RULES, keep=["page_id"]).count() == 0


# --- op 2


def test_chat_round_trip(spark):
    texts = [None, "", "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "back\\slash \\b \\p <\\p| \\n", "a\nb", "<|", "é😀" * 500]
    rows = [(7, i, role, t, "c") for i, (role, t) in enumerate(zip(["user", "assistant", None, "assistant", "we\\ird\nrole<|", "assistant", "assistant", "user"], texts, strict=True))]
    rows += [(None, 0, "assistant", "only", "c"), (None, 0, "user", "another", "c"), (8, 3, "user", "x", "c"), (8, 1, "user", "y", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    out = reply_trees.format_trees(reply_trees.as_tree(frame))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", reply_trees.read_back(F.col("formatted")).alias("turns"), reply_trees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {7, 8, None}
    assert [(t.role, t.text) for t in got[7].turns] == [(r or "", t or "") for _, _, r, t, _ in rows[:8]]
    assert got[7].loss == "".join(t or "" for _, _, r, t, _ in rows[:8] if r == "assistant")
    assert [t.text for t in got[8].turns] == ["y", "x"]
    alone = sorted(r.formatted for r in out.filter("conv_id is null").collect())
    assert alone == ["<|im_start|>assistant\nonly<|im_end|>\n", "<|im_start|>user\nanother<|im_end|>\n"]


def test_reply_tree_branches(spark):
    # 1 -> 2 -> 4, 1 -> 3; 5 has a missing parent; 6 and 7 form a cycle; conversation b has one message, twice
    rows = [("a", 1, None, "user", "r", 0.0), ("a", 2, 1, "assistant", "low", 0.1), ("a", 4, 2, "user", "deep", 0.2), ("a", 3, 1, "assistant", "high", 0.9), ("a", 5, 99, "user", "orphan", -5.0), ("a", 6, 7, "user", "c", 9.0), ("a", 7, 6, "user", "c", 9.0), ("b", 1, None, "user", "x", None), ("b", 1, None, "user", "x", None)]
    frame = spark.createDataFrame(rows, "conv_id string, msg_id long, parent_id long, role string, text string, s double")
    got = {(r.conv_id, r.leaf): [t.text for t in r.turns] for r in reply_trees.format_trees(frame, score="s", top=3).select("conv_id", "leaf", reply_trees.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {("a", 3): ["r", "high"], ("a", 4): ["r", "low", "deep"], ("a", 5): ["orphan"], ("b", 1): ["x"]}
    best = reply_trees.format_trees(frame, score="s", top=1).collect()
    assert {(r.conv_id, r.leaf) for r in best} == {("a", 3), ("b", 1)}
    assert reply_trees.format_trees(frame.limit(0)).count() == 0


def test_long_conversation(spark):
    n = 300
    frame = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = reply_trees.format_trees(reply_trees.as_tree(frame)).select(reply_trees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.loss == "".join(map(str, range(n)))


# --- op 3


def test_mixing_edges_and_targets(spark):
    rng = random.Random(2)
    rows = EDGE + [(100 + i, "w " * rng.randint(1, 60), "en", "a" if i % 3 else rng.choice(["b", "c", None])) for i in range(400)]
    frame = docs_of(spark, rows)
    got = mixing.mix(frame, ["doc_id"]).collect()
    again = mixing.mix(frame.repartition(7), ["doc_id"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = dict(zip(names, [5, 2, 1, 5], strict=False))
    target, budget, free = {}, 1.5 * sum(sizes.values()), list(names)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if 2 * sizes[s] <= weight[s] * level]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    by = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    ids = {}
    for i, _, _, s in rows:
        ids.setdefault(i, s)
    for r in got:
        by[ids[r.doc_id]] += r.taken
        assert r.source_size == sizes[ids[r.doc_id]]
        assert r.target == pytest.approx(target[ids[r.doc_id]])
    largest = max(r.size for r in got)
    for s in names:
        assert abs(by[s] - target[s]) <= 2 * largest
    assert mixing.mix(frame.limit(0), ["doc_id"]).count() == 0


# --- op 4


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = list(EDGE)
    for g in range(20):
        words = rng.sample(base, 120)
        for k in range(6):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(base)
            rows.append((1000 * g + 10 + k, " ".join(own), "en", "a"))
    frame = docs_of(spark, rows)
    got = simhash.near_duplicates(frame, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % 2**64 == brute_fingerprint(r.text)
    comp = brute_components([r.fp % 2**64 for r in got], 4)
    least = {}
    for r, c in zip(got, comp, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    for r, c in zip(got, comp, strict=True):
        assert r.component_id == least.get(c)
    assert len(set(comp)) < len(rows) - 20
    assert simhash.near_duplicates(frame.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("chunk", [40, 4096])
def test_simhash_links_in_hot_shards(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 250:  # a chain of near copies: one large component, shards far over the chunk
        v = rng.choice(sorted(values))
        for b in rng.sample(range(64), 3):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(150)} | {0}
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    members = {r.node: r.component for r in _common.connected_components(simhash.links(frame)).collect()}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    comp = brute_components(values, 4)
    groups, mine = {}, {}
    for v, c in zip(signed, comp, strict=True):
        groups.setdefault(c, set()).add(v)
        mine.setdefault(members.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_bk_forest_finds_every_pair():
    rng = np.random.default_rng(5)
    value = np.unique(np.concatenate([rng.integers(0, 2**63, 50, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 60, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 40, dtype=np.uint64))]))
    group = np.sort(rng.integers(0, 3, len(value)))
    forest = simhash.Forest(group, value)
    found = {(int(q), int(n)) for qs, ns in forest.search(group, value, 4) for q, n in zip(qs, ns, strict=True)}
    want = {(i, j) for i in range(len(value)) for j in range(len(value)) if group[i] == group[j] and (int(value[i]) ^ int(value[j])).bit_count() <= 4}
    assert found == want


@pytest.mark.parametrize("hub", [_common.HUB, 30])
def test_components_of_paths_and_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(_common, "HUB", hub)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(800, 801), (801, 800), (900, 900)]
    got = {r.node: r.component for r in _common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 700)}, 800: 800, 801: 800}


# --- op 7


def test_language_id_held_out_accuracy_and_edges(spark, sf):
    out = queries.op7_language_id(spark, sf).alias("p").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = out.filter("held_out").collect()
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    frame = docs_of(spark, EDGE)
    model = language_id.train(docs_of(spark, [(i, t, la, "s") for i, (t, la) in enumerate([("the and of", "en"), ("der und die", "de")] * 5)]))
    got = language_id.predict(frame, ["doc_id", "label"], model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 5)] == ["und"] * 5
    assert language_id.predict(frame, ["doc_id"], language_id.train(frame.limit(0))).first().lang_pred == "und"
    assert language_id.predict(frame.limit(0), ["doc_id"], model).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_samples_of_equal_rows(spark, seed):
    """Rows that repeat count once: no language, and no sample, is lost or filled by them."""
    rows = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(f"the text {seed}").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(None, "der und die", "de")] * 2, "doc_id long, text string, lang string")
    got = language_id.sample(rows.union(rare), "lang", "doc_id").collect()
    assert sorted(r.lang for r in got) == ["de", "en"]
    assert language_id.train(rows.union(rare)).names == ["de", "en"]
    assert _common.hash_sample(rows, F.xxhash64("text"), 2000).count() == 1
    many = spark.range(250).withColumn("h", F.xxhash64("id"))
    least = sorted(r.h for r in many.collect())[:100]
    assert [r.h for r in _common.hash_sample(many.union(many), F.col("h"), 100).collect()] == least
    assert _common.hash_sample(many.limit(0), F.col("h"), 100).count() == 0
    assert secrets.train(rows)[0].shape == (len(secrets._ALPHABET) + 1, len(secrets._ALPHABET))


def test_many_languages(spark, monkeypatch):
    """More languages than one pass takes: the same predictions as in one pass."""
    rng = random.Random(9)
    own = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(30)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(own[la], k=40)), la, "s") for i, la in enumerate(sorted(own) * 3)]
    frame = docs_of(spark, rows + [(999, None, None, "s"), (998, "123", "en", "s")])
    model = language_id.train(frame)
    assert sorted(own) == model.names
    got = {}
    for size in (64, 13, 100):
        monkeypatch.setattr(language_id, "LANGUAGES", size)
        got[size] = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(frame, ["doc_id"], model).collect()}
    assert got[64] == got[13] == got[100]
    assert all(got[64][i][0] == la for i, _, la, _ in rows) and got[64][999] == got[64][998] == ("und", 0.0)


# --- op 8


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    rng = random.Random(6)
    key = "".join(rng.choices(secrets._ALPHABET[:62], k=40))
    texts = [None, "", "Password: hunter22 and PASSWD='x'", "é token = \"abc.def/12\" AKIA" + "Q7" * 10, "a" * 30 + " deadbeef" * 2, "see " + key + " here", "an_ordinary_identifier_of_some_length and internationalisation-of-words", "api_key=1 apikey:123456 secret:secret:abcdef", "0" * 5000]
    frame = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: r for r in secrets.find_secrets(frame, ["doc_id"], model, redact="<X>").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        joined = ",".join(f"{b[3]}:{b[0]}:{b[2]}" for b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert got[5].spans == f"markov:4:{4 + len(key)}" and got[5].redacted == "see <X> here"
    assert got[6].spans == "" and got[6].redacted == texts[6] and got[0].redacted is None
    assert secrets.find_secrets(frame.limit(0), ["doc_id"], secrets.train(frame.limit(0))).count() == 0


# --- op 9


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_quality_statistics(spark, sf):
    texts = [t for _, t, _, _ in EDGE] + ["a b c a b c", "x y\nx y\n\n\nx y", "é|é #", "p q r s p q r", "a a a a"] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for t in texts:
        assert quality.statistics(t)[0] == brute_stats(t)
    assert quality.statistics("a\u00a0b \u2003")[0][0] == 2


def test_quality_judgement(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs.unionByName(docs.limit(3)), labels, ["doc_id"]).collect()
    assert len(got) == docs.count() + 3
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    passed = [r for r in got if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.97 * len(passed)
    frame = docs_of(spark, EDGE)
    assert quality.judge(frame, labels.limit(0), ["doc_id"]).count() == len(EDGE)
    assert quality.judge(frame.limit(0), labels, ["doc_id"]).count() == 0


def test_kept_against_brute_force(spark, sf):
    """Paths through every tree, scores, cut-offs and verdicts recomputed row by row in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.judge(docs, labels, ["doc_id"]).collect()}
    stats = quality.rule_statistics(docs, ["doc_id"])
    forests = quality.fit(stats)
    rows = {r.doc_id: r for r in stats.collect() if not r.base_failed}

    def score(forest, x):
        total = 0.0
        for feature, value, left, right, length in forest.trees:
            k = 0
            while feature[k] >= 0:
                k = left[k] if x[feature[k]] < value[k] else right[k]
            total += length[k]
        return 2 ** (-total / len(forest.trees) / quality.average_path(forest.psi))

    good, bad = ({r.doc_id for r in labels.filter(f"quality = {q}").collect()} for q in (1, 0))
    gone = set()
    for k, (name, own) in enumerate(quality.FORESTS.items()):
        scores = {i: score(forests[name], [r[c] for c in own]) for i, r in rows.items()}
        assert all(got[i].anomaly[k] == pytest.approx(x) for i, x in scores.items())
        bins = {i: math.floor(got[i].anomaly[k] * quality.BINS) for i in rows}
        best = (0, None)
        for t in sorted({b for i, b in bins.items() if i in good | bad}):
            lost, caught = (sum(bins[i] >= t for i in kind & bins.keys()) for kind in (good, bad))
            if lost <= (1 - quality.KEEP_GOOD) / len(quality.FORESTS) * len(good & bins.keys()) and caught > lost and caught >= best[0]:
                best = (caught, t)
        gone |= {i for i in rows if best[1] is not None and got[i].anomaly[k] >= best[1] / quality.BINS}
    assert {i for i, r in got.items() if r.kept} == rows.keys() - gone
    assert gone & bad and not gone & good


def test_isolation_forest_isolates():
    rng = np.random.default_rng(7)
    rows = np.r_[rng.normal(0, 1, (1000, 3)), [[9, 9, 9]]]
    score = quality.IsolationForest(rows, 100, 256).score(rows)
    assert score.argmax() == 1000
