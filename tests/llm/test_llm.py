"""Operators of the training-data pipeline against brute force, on small fixtures with every awkward row."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, fingerprints, jaccard, license_scan, lm, packing, quality, registry, sharding, url_filter

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty and blank texts, copies, a very long text, odd characters, a repeated row, and columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", "   \n", "a", "a", base, base, base.replace("word40", "x"), base.upper(), "Ünï cödé ß ÷ × \u0301 日本 \u00a0 \x1c end", "released under the MIT License.", " ".join(f"t{i % 997}" for i in range(30000))]
    data = [*rows(texts), (5, base, "en", "s", 1), (None, base, None, None, None), (20, base, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("_id", "_text", "digest", "ids", "shard", "node", "kept", "key", "block", "size")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pd_rows(df):
    return [r.asDict() for r in df.collect()]


# 1


def test_templates():
    t = license_scan.Template
    a = license_scan.Automaton([t("x", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four"), t("y", 'by <<var;name="n";words="1-2">> end')])
    scan = lambda s: [(a.templates[k].label, i, j) for k, i, j in a.scan(license_scan.words_of(s))]
    assert scan("One, four!") == [("x", 0, 2)]
    assert scan("one two four one two three four") == [("x", 0, 3), ("x", 3, 7)]
    assert scan("one three four one two") == []
    assert scan("by end") == [] and scan("by a b end") == [("y", 0, 4)] and scan("by a b c end") == []
    assert scan("by end end") == [("y", 0, 3)]
    with pytest.raises(ValueError):
        license_scan.Automaton([t("z", "<<beginOptional>>all<<endOptional>>")])


def test_phrases_equal_plain_search(spark, docs, awkward):
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    for df in (docs, awkward):
        texts = df.select("doc_id", "text").collect()
        found = license_scan.scan_licenses(df).collect()
        got = collections.Counter((r.doc_id, r.n_words, tuple(sorted((m.start, m.label) for m in r.matches if m.base))) for r in found)
        want = collections.Counter()
        for r in texts:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOW))
            hits = sorted((i, v) for k, v in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(k)]) == k)
            want[r.doc_id, len(w), tuple(hits)] += 1
        assert got == want
    assert {r["labels"] for r in pd_rows(registry.QUERIES["op1_license_scan"](spark, SF))} >= {"", "mit"}


# 2


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 6000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    nulls = spark.createDataFrame([(None,)], "key string")
    cascade = url_filter.Cascade(universe.union(universe.limit(5)).union(nulls), listed, keys_per_shard=700)
    marked = cascade.mark(universe.withColumn("_h2", F.lit(1)), F.array("key"), "hit")
    assert marked.where(F.col("hit")[0] != (F.substring("key", 2, 9).cast("int") % 7 == 0)).count() == 0
    cascade.broadcast_bytes = 1  # every shard in a pass of its own
    assert cascade.mark(universe, F.array("key"), "hit").where("hit[0]").count() == math.ceil(5000 / 7)
    none = url_filter.Cascade(universe, nulls)
    assert none.mark(universe, F.array("key"), "hit").where("hit[0]").count() == 0


def test_url_rules(spark):
    urls = [None, "", "nope", "http://", "HTTP://A.NET/x", "http://net", "http://b.example.net/en/1?q#f", "http://b.example.net/enx", "http://example.com/de/", "http://xexample.com/de/", "ftp://q.org/fr/?", "http://m.free-bets.example.com/a", "http://x?y://z.net/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "_id": F.lit(2)})
    listed = spark.createDataFrame([(d,) for d in url_filter.LISTED], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.RULES, listed).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "/x", "net/", "block") and got[5] == ("net", "", None, "allow")
    assert got[6] == ("b.example.net", "/en/1", "example.net/en/", "allow") and got[7][2:] == ("net/", "block")
    assert got[8][2:] == ("example.com/de/", "block") and got[9][2:] == (None, "allow") and got[10][2:] == ("org/fr/", "allow")
    assert got[11][2:] == (None, "block") and got[12] == ("x", "", None, "allow")


# 3


def kneser_ney(texts, order, base, alphabet):
    """p(symbol | context) by the definition, from plain counters."""
    counts = {order: collections.Counter()}
    for t in texts:
        s = [0] * (order - 1) + [alphabet.get(c, base - 1) for c in t] + [0]
        for i in range(len(s) - order + 1):
            counts[order][tuple(s[i : i + order])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(0.0, i - (i + 1) * y * b / a), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    def p(g):
        if not g:
            return 1 / base
        k = len(g)
        inside = [v for h, v in counts[k].items() if h[:-1] == g[:-1]]
        if not inside:
            return p(g[1:])
        v = counts[k].get(g, 0)
        held = sum(cuts[k][min(x, 3) - 1] for x in inside)
        return (max(v - (cuts[k][min(v, 3) - 1] if v else 0), 0) + held * p(g[1:])) / sum(inside)

    return p


def stretch_of(text, order):
    import pyarrow as pa

    return quality.Stretch(*next(quality.stretches(pa.array([text]), order, 10**6)), order)


def plain_perplexity(texts, order):
    """Perplexity of a text under the model of ``texts``, by the definition."""
    base = len(set("".join(texts))) + 2
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
    p = kneser_ney(texts, order, base, alphabet)

    def of(text):
        s = [0] * (order - 1) + [alphabet.get(c, base - 1) for c in text] + [0]
        return 10 ** (-sum(math.log10(p(tuple(s[i : i + order]))) for i in range(len(text) + 1)) / (len(text) + 1))

    return p, base, alphabet, of


def test_model_equals_the_definition(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat", "", "aaa aab", "日本"]
    asked = ["the cat", "zzz", "", "a dog sat on", "mat é", "日", "the cat sat on the mat " * 7]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "_text string"), order=3)
    p, base, alphabet, of = plain_perplexity(texts, 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id bigint, text string")
    for stretch in (5, 1000):  # long texts are cut
        out = quality.score(df, model, "doc_id", "text", [F.col("doc_id").alias("_id")], order=3, least_blocks=3, stretch=stretch).collect()
        assert len(out) == len(asked) and all(r.n_symbols == len(asked[r._id]) + 1 and abs(r.perplexity / of(asked[r._id]) - 1) < 1e-4 for r in out)
    s = [0] + [alphabet["t"]]
    assert abs(sum(p((*s, x)) for x in range(base)) - 1) < 1e-9


def test_verdicts_equal_brute_force(spark):
    """Perplexities, thresholds by language and length, and who stays; de has few trusted documents, fr none."""
    rng = random.Random(3)
    words = {"en": ["tree", "stone", "river", "cloud"], "de": ["baum", "stein", "fluss"], "fr": ["arbre", "roche"]}
    data = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(1, 30))), g) for i, g in enumerate(["en"] * 60 + ["de"] * 9 + ["fr"] * 5)]
    data += [(100 + i, "".join(rng.choice("xqz#% ") for _ in range(40)), g) for i, g in enumerate(["en", "de", "fr"] * 3)]
    good = [i for i, _, g in data if i < 100 and g != "fr"]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(100, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels, quantile=0.9, order=3).collect()}
    of = plain_perplexity([t for i, t, _ in data if i in good], 3)[3]
    value = {i: of(t) for i, t, _ in data}
    band = {i: int(math.log2(len(t) + 1) / 2) for i, t, _ in data}
    at = lambda ids: sorted(value[i] for i in ids)[math.ceil(0.9 * len(ids)) - 1]
    for i, t, g in data:
        own = [j for j, _, h in data if j in good and h == g]
        long = [j for j in own if band[j] == band[i]]
        limit = at(long) if len(long) >= 10 else at(own) if own else at(good)
        r = out[i]
        assert abs(r.perplexity / value[i] - 1) < 1e-4 and abs(r.threshold / limit - 1) < 1e-4
        assert r.kept == (value[i] <= limit * (1 + 1e-6))
    assert not any(out[i].kept for i in value if i >= 100) and len({out[i].threshold for i in good if band[i] == 3}) > 1


def test_large_alphabets(spark):
    """6,000 different characters, as mixed Chinese and Japanese text has."""
    texts = ["".join(chr(0x4E00 + (7 * i + j) % 6000) for j in range(300)) for i in range(0, 6000, 30)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    assert quality.classify(docs, labels).where("kept AND perplexity < 50").count() > 190


def test_languages_have_their_own_thresholds(spark):
    found = registry.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").where("n_symbols > 1000").groupBy("lang").agg(F.min("threshold").alias("t")).collect()
    assert len(found) >= 4 and len({r.t for r in found}) == len(found)


def test_quality_keeps_clean_text(spark):
    found = registry.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.quality: r.k for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert found.count() == 1000 and got[1] > 0.97 and got[0] < 0.3


def test_quality_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, 0), (7, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(awkward, labels)
    assert out.count() == awkward.count() and out.where("kept IS NULL").count() == 0
    assert quality.keep_quality(awkward, labels).columns == awkward.columns
    no_labels = labels.where("quality = 9")
    assert quality.classify(awkward, no_labels).where("kept AND perplexity IS NULL").count() == awkward.count()
    assert quality.classify(empty, labels).count() == 0


# 4


def test_exact_dedup(spark, awkward, empty):
    got = exact_dedup.exact_dedup(awkward)
    data = awkward.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in data:
        groups[r.text or ""].append(r.doc_id)
    want = collections.Counter()
    for ids in groups.values():
        keep = max([i for i in ids if i is not None], default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, 4)
    first.add(spark.createDataFrame(rows(["a", "b", "a"]), SCHEMA))
    spark.sql(f"DROP TABLE {first.table}")  # as in a new session: the files stay
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(spark.createDataFrame(rows(["b", "c", "c", None], 10), SCHEMA)).collect()}
    assert got == {10: (1, False), 11: (12, False), 12: (12, True), 13: (13, True)}
    assert again.rows().count() == 4 and again.rows().select("digest").distinct().count() == 4
    plan = again.rows().join(again.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# 5


def components(data):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(data):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(data, sets)))


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"n{rng.randrange(9999)}"], [w[k], f"m{rng.randrange(9999)}"]]) or ["z"]
    return " ".join(w)


def test_jaccard_equals_brute_force(spark, awkward, docs, empty):
    rng = random.Random(5)
    texts = []
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 15, 20, 30, 45, 70, 110, 180, 300):
        words = [f"w{rng.randrange(50) if size < 30 else rng.randrange(5000)}" for _ in range(size)]
        texts += [edited(rng, words, c) for c in (0, 0, 1, 1, 2, 3, size // 20, size // 12)]
    group = [f"g{i}" for i in range(120)]  # a large group of near copies, some of them too far from most others
    texts += [edited(rng, group, rng.randrange(0, 8)) for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))  # and a passage that many documents share
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(n)) for n in (0, 3, 8, 12, 15, 40) * 5]
    made = spark.createDataFrame(rows(texts), SCHEMA)
    for df in (made, awkward, docs, empty):
        data = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
        assert got == components(data)
    small_blocks = jaccard.jaccard_components(made, first_turns=1, block=7, query_block=3)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in small_blocks.collect()) == components([tuple(r) for r in made.select("doc_id", "text").collect()])


def test_kept_entries_meet():
    """Any two sets at the threshold share an entry, whatever is common."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 70), 100, 121, 122, 300, 718, 719, 2000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a
            while True:  # as many changes as the threshold allows
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
                both = len(np.intersect1d(a, c))
                if 5 * both < 4 * (len(a) + len(c) - both):
                    break
                b = c
            common = np.sort(rng.choice(a, len(a) // 3, replace=False))
            assert len(np.intersect1d(jaccard.entries(a, common), jaccard.entries(b, common)))


# 6


def test_bpe_equals_tiktoken(spark, docs, awkward, empty):
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, awkward, empty):
        out = bpe.decode_column(bpe.encode_column(df.select("*", F.lit(1).alias("decoded")), block_chars=5000, kept_pieces=1000)).collect()
        assert len(out) == df.count()
        for r in out:
            assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    replay, rng = bpe.MergeReplay(ranks), random.Random(4)
    for _ in range(500):
        word = "".join(rng.choice("aabbnins éß日ing") for _ in range(rng.randrange(1, 25)))
        assert replay.encode([word.encode()])[0] == plain._encode_single_piece(word) if word.encode() not in ranks else [ranks[word.encode()]]


# 7


def plain_scores(texts, held, priors):
    """Base and model log10 probabilities of token lists by the definition, from plain counters; and p(token | context)."""
    counts = collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            for i, w in enumerate(t):
                counts[w,] += 1
                for k in range(2, min(i + 1, len(priors)) + 2):
                    counts[(*(["<s>"] + t)[i + 2 - k : i + 1], w)] += 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    counts["<s>",] = counts[None,]

    def p(context, w):
        if not context:
            return ((counts[w,] if w != "<s>" else 0) + 0.1) / (n + 0.1 * (v + 1))
        m = priors[len(context) - 1]
        return (counts[(*context, w)] + m * p(context[1:], w)) / (counts[context] + m)

    def score(t):
        padded = ["<s>", *t]
        return sum(math.log10(p(tuple(padded[max(0, i + 1 - len(priors)) : i + 1]), w)) for i, w in enumerate(t))

    return counts, n, p, score


@pytest.mark.parametrize("priors", [(150.0,), (150.0, 25.0), (9.0, 4.0, 2.0)])
def test_lm_equals_plain_counts(spark, docs, awkward, empty, priors):
    for df in (docs, awkward):
        data = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        tokens = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + [None] for _, t in data]
        held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in data]
        counts, n, p, score = plain_scores(tokens, held, priors)
        want = collections.Counter()
        for (d, _), t, h in zip(data, tokens, held):
            want[d, h, len(t), sum(counts[w,] > 0 for w in t), n, f"{sum(math.log10(p((), w)) for w in t):.8e}", f"{score(t):.8e}"] += 1
        out = lm.score_texts(df, priors=priors, block_bytes=60_000, shard_bytes=40_000, least_blocks=3, stride=37).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8e}", f"{r.score:.8e}") for r in out) == want
    assert lm.score_texts(empty).count() == 0


def test_automaton_arcs_add_up_to_one():
    import pyarrow as pa

    texts = [b"a b a b c", b"b c a", b"", b"a b c c c a b d"]
    grams = lm.Grams(pa.array(texts), np.zeros(len(texts), dtype=bool), 3)
    n = len(grams.keys[1])
    tokens, types = int(grams.local[1].sum()), n
    grams.totals = grams.local
    a = lm.Automaton(grams, tokens, types, 0.1, (5.0, 2.0))
    every = np.arange(len(a.fail))
    over, _ = a.step(every.copy(), np.full(len(every), np.searchsorted(grams.keys[1], lm.END)))
    for state in set(every) - set(over):  # a text's end is never left
        _, w = a.step(np.full(n, state), np.arange(n))
        unknown, s = math.log10(0.1 / (tokens + 0.1 * (types + 1))), state
        while s:
            unknown, s = unknown + a.fail_weight[s], int(a.fail[s])
        assert abs((10.0**w).sum() + 10.0**unknown - 1) < 1e-9


def test_copies_score_higher(spark):
    """Texts that training holds once more stand out from those it does not: the model is the corpus's."""
    rng = random.Random(8)
    make = lambda: " ".join(f"w{min(int(rng.paretovariate(0.6)), 4000)}" for _ in range(120))
    texts = [make() for _ in range(400)]
    texts += texts[:60]
    out = lm.score_texts(spark.createDataFrame(rows(texts), SCHEMA), least_blocks=5).where("held_out").collect()
    twice = [r.score / r.n_tokens for r in out if r.doc_id < 60 or r.doc_id >= 400]
    once = [r.score / r.n_tokens for r in out if 60 <= r.doc_id < 400]
    assert min(twice) > max(once)


# 8


def check_packing(out, texts, capacity):
    encoder = Tokenizer.from_file(packing.VOCABULARY)
    want = collections.Counter()
    for d, t in texts:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in out)
    return len(places), -(-total // capacity)


def test_packing(spark, docs, awkward, empty):
    for df in (docs, awkward):
        out = packing.pack(df).collect()
        found, least = check_packing(out, [tuple(r) for r in df.select("doc_id", "text").collect()], 2048)
        assert found <= least + 1
    assert packing.pack(empty).count() == 0


def test_plan_reaches_the_optimum():
    assert sum(n for n, _ in packing.plan_packing({6: 1, 5: 2, 4: 1}, 10)) == 2
    assert sum(n for n, _ in packing.best_fit_decreasing({7: 1, 5: 2, 4: 2, 3: 1, 2: 1}, 10)) >= 3
    assert sum(n for n, _ in packing.plan_packing({7: 1, 5: 2, 4: 2, 3: 1, 2: 1}, 10)) == 3
    for seed in range(30):
        rng = random.Random(seed)
        counts = collections.Counter(rng.randrange(1, 21) for _ in range(rng.randrange(1, 60)))
        plan = packing.plan_packing(counts, 20)
        used = collections.Counter()
        for n, p in plan:
            assert sum(p) <= 20
            for x in p:
                used[x] += n
        assert used == counts
        assert sum(n for n, _ in plan) <= sum(n for n, _ in packing.best_fit_decreasing(counts, 20))
    big = {1500: 10**9, 548: 10**9, 100: 7}
    assert sum(n for n, _ in packing.plan_packing(big, 2048)) == 10**9 + 1
    assert packing.plan_packing({}) == []


# 9


def test_sharding(spark, docs, awkward, empty):
    for df, shards in ((docs, 8), (awkward, 3), (docs, 1)):
        out = sharding.shard_by_bytes(df, shards, least_ranges=16).collect()
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
        by = collections.defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
        most = max(r["size"] for r in out)
        even = sum(r["size"] for r in out) / shards
        assert all(abs(sum(r["size"] for r in rs) - even) <= 2 * most for rs in by.values())
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_splits_a_hot_text(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.shard_by_bytes(hot, 8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    total = sum(r.b for r in out)
    assert len(out) == 8 and all(abs(r.b - total / 8) <= 20 and r.m == r.n - 1 for r in out)


# 10


def test_fingerprints(spark, docs, awkward, empty):
    lone = spark.createDataFrame(rows(["only one"]), SCHEMA)
    for df in (docs, awkward, lone):
        data = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in df.select("doc_id", "text").collect()])
        want = collections.Counter()
        for (_, _, t, d), (_, _, nxt, _) in zip(data, data[1:] + data[:1]):
            half = len(t) // 2
            e = t[: len(t) - half] + nxt[:half]
            a, b, c = fingerprints.fingerprint(t), fingerprints.fingerprint(e), fingerprints.fingerprint(nxt)
            want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)] += 1
        assert collections.Counter(tuple(r) for r in fingerprints.fingerprint_with_next(df).collect()) == want
    assert fingerprints.fingerprint_with_next(empty).count() == 0


def test_likeness_is_bounded_and_tells_edits():
    f = fingerprints.fingerprint
    a, b = "lorem ipsum dolor sit amet " * 30, "completely other words stand here now " * 20
    assert fingerprints.likeness(f(a), f(a)) == 1.0 and f(None) == f("")
    near = fingerprints.likeness(f(a), f(a[:-40] + b[:40]))
    assert 0 <= fingerprints.likeness(f(a), f(b)) < near <= 1
    assert fingerprints.difference(f(a), f(b)) == fingerprints.difference(f(b), f(a))


# the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    data = [(r.doc_id, r.text) for r in good.collect()]
    last = {t: max(d for d, u in data if u == t) for _, t in data}
    data = [(d, t) for d, t in data if last[t] == d]
    kept = {c for _, _, c in components(data)}
    data = [(d, t) for d, t in data if d in kept]
    check_packing(corpus_pipeline.run(spark, SF).collect(), data, 2048)


def test_stages_on_awkward_rows(spark, awkward, empty):
    rows_ = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    exact = corpus_pipeline.exact(spark, rows_, SF)
    assert exact.count() == rows_.select(F.coalesce("text", F.lit(""))).distinct().count()
    near = corpus_pipeline.near(spark, exact, SF)
    assert near.columns == rows_.columns and near.count() < exact.count()
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.packing):
        assert stage(spark, empty, SF).count() == 0


def test_oracles_name_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
