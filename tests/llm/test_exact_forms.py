"""Brute-force forms of what the training-data operators promise: matchers, optima, indexes, rows with clashing names."""

import collections
import functools
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, fingerprints, license_scan, packing, sharding, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def parse(markup):
    """Markup as nested lists: words, ("optional", inner) and ("any", least, most)."""
    stack = [[]]
    for k, part in enumerate(re.split(r"<<(beginOptional|endOptional|var;[^>]*)>>", markup)):
        if k % 2 == 0:
            stack[-1] += [w.decode() for w in license_scan.words_of(part)]
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("any", *map(int, re.search(r'words="(\d+)-(\d+)"', part).groups())))
    return stack[0]


def ends(pattern, words, at):
    """All places where a match of ``pattern`` from ``at`` may end."""
    found = {at}
    for part in pattern:
        if isinstance(part, str):
            found = {i + 1 for i in found if i < len(words) and words[i] == part}
        elif part[0] == "optional":
            found |= {j for i in found for j in ends(part[1], words, i)}
        else:
            found = {i + n for i in found for n in range(part[1], part[2] + 1) if i + n <= len(words)}
    return found


def random_markup(rng, depth=0):
    out = [rng.choice("abc")]
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(4)
        if kind == 0 and depth < 2:
            out.append(f"<<beginOptional>>{random_markup(rng, depth + 1)}<<endOptional>>")
        elif kind == 1:
            least = rng.randrange(3)
            out.append(f'<<var;name="v";words="{least}-{least + rng.randrange(3)}">>')
        else:
            out.append(rng.choice("abcd"))
    return " ".join(out)


def test_automaton_equals_a_plain_matcher():
    rng = random.Random(1)
    for _ in range(200):
        templates = [license_scan.Template(f"t{i}", random_markup(rng)) for i in range(3)]
        automaton = license_scan.Automaton(templates)
        words = [rng.choice("abcd") for _ in range(rng.randrange(15))]
        got = set(automaton.scan([w.encode() for w in words]))
        want = {(k, i, max(e)) for k, t in enumerate(templates) for i in range(len(words)) if (e := ends(parse(t.markup), words, i) - {i})}
        assert got == want


def test_query_labels_and_score_equal_a_plain_matcher(spark):
    from tidemark.llm.registry import QUERIES

    patterns = [(t, parse(t.markup)) for t in license_scan.PHRASES + license_scan.NOTICES]

    def mandatory(pattern):
        return sum(isinstance(p, str) for p in pattern)

    found = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode("utf-8", "replace") for w in license_scan.words_of(r.text)]
        firsts = {p[0] if isinstance(p[0], str) else None for _, p in patterns}
        hits = [(t, p) for i, w in enumerate(words) if w in firsts or None in firsts for t, p in patterns if ends(p, words, i) - {i}]
        assert found[r.doc_id].labels == ",".join(sorted({t.label for t, _ in hits}))
        most = max((mandatory(p) for _, p in hits), default=0)
        assert abs(found[r.doc_id].score - most / (most + 2)) < 1e-12


def test_whole_license_with_its_copyright_line():
    from test_notices import BSD, ISC, MIT

    a = license_scan.Automaton(license_scan.PHRASES + license_scan.NOTICES)
    for head, text, label in (("The MIT License (MIT)\n\nCopyright (c) 2015-2020 Jane Doe and contributors\n\n", MIT, "mit"), ("ISC License\n\nCopyright 2020, J.\n", ISC, "isc"), ("BSD 3-Clause License\n\nCopyright (c) 2019, A. Uthor\nAll rights reserved.\n\n", BSD.format(""), "bsd")):
        words = license_scan.words_of(head + text)
        found = {(a.templates[k].label, i, j) for k, i, j in a.scan(words)}
        start = words.index(label.encode())
        assert (label, start, len(words)) in found


def test_license_scan_of_an_empty_table(empty):
    assert license_scan.scan_licenses(empty).count() == 0


# 2


def test_url_filter_edges(spark):
    schema = "page_id bigint, url string, html string"
    listed = spark.createDataFrame([("a.example.com",)], "key string")
    judge = lambda data: url_filter.filter_urls(spark.createDataFrame(data, schema), url_filter.RULES, listed)
    assert judge([]).count() == 0
    url = "http://" + ".".join(["x"] * 300) + ".a.example.com/" + "p" * 100_000
    got = judge([(1, url, None), (1, url, None), (2, "http://b.example.com/", None)]).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (1, "block"), (2, "allow")]


def test_cascade_hashes_are_independent(spark):
    keys = spark.range(10).select(F.col("id").cast("string").alias("k"))
    a = [tuple(r) for r in keys.select(url_filter._h1(F.col("k")), url_filter._h2(F.col("k"))).collect()]
    chained = [r[0] for r in keys.select(F.xxhash64(F.col("k"), F.lit(1))).collect()]
    assert len(set(a)) == 10 and all(h2 != c for (_, h2), c in zip(a, chained))


# 4


def test_index_of_one_file_a_bucket_is_neither_shuffled_nor_sorted(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/grown", 4)
    for k in range(3):
        index.add(spark.createDataFrame(rows([f"t{k}-{i}" for i in range(40)], 100 * k), SCHEMA))
    compacted = index.compact(f"file://{tmp_path}/compacted")
    assert sorted(compacted.rows().collect()) == sorted(index.rows().collect()) and compacted.rows().count() == 120
    new = spark.createDataFrame(rows([f"t1-{i}" for i in range(50)]), SCHEMA).select(exact_dedup.text_digest().alias("digest"))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = new.join(compacted.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    right = plan[plan.rindex("Exchange") :]  # the new side is shuffled; what follows is the index side
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and compacted.table in right and "Sort [" not in right
    got = {r.doc_id: r.kept for r in compacted.add(spark.createDataFrame(rows(["t1-3", "new"], 900), SCHEMA)).collect()}
    assert got == {900: False, 901: True}
    index.close()
    compacted.close()


def test_queries_leave_no_table_and_hot_texts_are_whole(spark):
    texts = ["hot"] * 900 + [f"t{i % 50}" for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert len(got) == 1200 and sum(r.kept for r in got) == 51
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 900} == {(899, 900)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


# 8


def fewest_sequences(pieces, capacity):
    """The optimum, by trying every filling around the largest piece."""

    @functools.cache
    def solve(left):
        if not left:
            return 0
        best, rest = len(left), left[1:]

        def fill(at, room, taken):
            nonlocal best
            best = min(best, 1 + solve(tuple(x for i, x in enumerate(rest) if i not in taken)))
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    fill(i + 1, room - rest[i], taken | {i})

        fill(0, capacity - left[0], frozenset())
        return best

    return solve(tuple(sorted(pieces, reverse=True)))


def test_plans_reach_the_optimum_of_small_cases():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 37])
        pieces = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        counts = collections.Counter(pieces)
        best = fewest_sequences(pieces, capacity)
        assert packing.lower_bound(counts, capacity) <= best
        assert sum(n for n, _ in packing.plan_packing(counts, capacity)) == best


def test_bounds_and_dominance():
    assert packing.lower_bound({6: 3}, 10) == 3 and packing.lower_bound({6: 2, 5: 2}, 10) == 3 and packing.lower_bound({2048: 4, 1: 1}, 2048) == 5
    assert packing.dominated((3, 2), (5,)) and packing.dominated((3, 2), (3, 2, 1)) and not packing.dominated((5,), (3, 2))
    kept, _ = packing.fillings({5: 1, 3: 1, 2: 1}, [2, 3, 5], 5, 9, 100, 12)
    assert kept == [(5,)]


def test_copies_of_one_row_are_packed(spark):
    same = spark.createDataFrame(rows(["a b c"] * 1), SCHEMA).crossJoin(spark.range(500).select(F.lit(1).alias("_deal")))
    out = packing.pack(same.drop("_deal")).collect()
    assert len(out) == 500 and len({(r.sequence_id, r.offset) for r in out}) == 500


# 9


def test_shards_of_equal_and_very_long_texts(spark):
    """Small groups of equal texts stay together on small tables too; rows that repeat id and text are split where they must."""
    texts = [f"text {i // 3} " + "x" * 200 for i in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows(texts), SCHEMA), 8).collect()
    of = collections.defaultdict(set)
    for r in out:
        of[r.doc_id // 3].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    long = rows(["y" * 50_000] + [f"{i:04d}" * 25 for i in range(4000)])
    sizes = collections.Counter()
    for r in sharding.shard_by_bytes(spark.createDataFrame(long, SCHEMA), 8).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 50_001
    same = spark.createDataFrame([(None, "z", "en", "s", 1)] * 800, SCHEMA)
    out = sharding.shard_by_bytes(same, 8, least_ranges=16).collect()
    assert sorted(collections.Counter(r.shard for r in out).values()) == [100] * 8


# 10


def plain_digest(text):
    """The digest from plain counters: three kinds of byte triplets, buckets by multiplicative hash, quartiles of the counts."""
    data, counts = text.encode(), [0] * 256
    for salt, (i, j) in enumerate(((1, 2), (1, 3), (2, 4))):
        for at in range(len(data) - j):
            v = data[at] | data[at + i] << 8 | data[at + j] << 16 | salt << 24
            counts[(v * 2654435761 % 2**32 >> 15) % 256] += 1
    q1, q2, q3 = (sorted(counts)[64 * k - 1] for k in (1, 2, 3))
    import math

    head = f"{min(255, round(8 * math.log2(1 + len(data)))):02x}" + "".join(f"{min(15, 16 * q // q3) if q3 else 0:x}" for q in (q1, q2))
    code = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    return head + bytes(sum(code[4 * b + k] << 2 * k for k in range(4)) for b in range(64)).hex()


def plain_difference(a, b):
    steps = {0: 0, 1: 1, 2: 2, 3: 6}
    gap = abs(int(a[:2], 16) - int(b[:2], 16))
    score = gap if gap <= 1 else 2 * gap
    for i in (2, 3):
        gap = abs(int(a[i], 16) - int(b[i], 16))
        score += gap if gap <= 1 else 3 * (gap - 1)
    x, y = (bytes.fromhex(d[4:]) for d in (a, b))
    return score + sum(steps[abs((p >> s & 3) - (q >> s & 3))] for p, q in zip(x, y) for s in (0, 2, 4, 6))


def test_digests_equal_plain_counting():
    rng = random.Random(6)
    texts = ["", "a", "ab", "abc", "é日本", *(" ".join(rng.choice(["lorem", "ipsum", "döner", "x"]) for _ in range(n)) for n in (3, 30, 300))]
    for a in texts:
        assert fingerprints.fingerprint(a) == plain_digest(a)
        for b in texts:
            assert fingerprints.difference(plain_digest(a), plain_digest(b)) == plain_difference(plain_digest(a), plain_digest(b))


# the pipeline


def test_stages_keep_columns_of_any_name(spark):
    base = " ".join(f"word{i}" for i in range(60))
    data = [(i, t, "en", "s", 1) for i, t in enumerate([base, base, base.replace("word7", "x"), "other", None, ""])]
    docs = spark.createDataFrame(data, SCHEMA)
    names = ("__id", "__digest", "__row", "_key0", "_key1", "_row", "digest", "_id")
    docs = docs.withColumns({c: F.lit(88) + k for k, c in enumerate(names)})
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    from tidemark.llm.quality import keep_quality

    for stage in (lambda d: keep_quality(d, labels, quantile=0.5), lambda d: corpus_pipeline.exact(spark, d, SF), lambda d: corpus_pipeline.near(spark, d, SF)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all([r[c] for c in names] == [88 + k for k in range(len(names))] for r in out.collect())


def test_quality_stage_on_no_rows_and_awkward_rows(spark, empty):
    assert corpus_pipeline.quality(spark, empty, SF).count() == 0
    data = [(0, None, None, None, None), (None, "", "en", None, 0), (None, "abc " * 20_000, "xx", "s", 1), (3, "日本" * 9, "ja", "s", 1), (3, "日本" * 9, "ja", "s", 1)]
    out = corpus_pipeline.quality(spark, spark.createDataFrame(data, SCHEMA), SF)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and out.count() <= 5
    near = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, spark.createDataFrame(data, SCHEMA), SF), SF)
    packed = corpus_pipeline.packing(spark, near, SF)
    assert packed.where("length < 1 OR length > 2048").count() == 0 and packed.select("doc_id").distinct().count() == near.select("doc_id").distinct().count()
    assert hashlib.sha256(b"").hexdigest() in {r.h for r in near.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
