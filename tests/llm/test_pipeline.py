"""The stages of the pipeline, each on its own and all together, against brute force and on the hard cases."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonalis.llm import decontam, langid
from tonalis.llm.common import give_heap_back

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "the quick brown fox jumps over a lazy dog and then it sleeps again", "de": "der schnelle braune fuchs springt über einen faulen hund und schläft dann wieder"}


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(LETTERS[lang].split()) for _ in range(n))


def unlike(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, empty and long texts, several texts of one id, repeated rows, clashing names."""
    near = unlike(5, 200).split()
    other = [*near[:100], "changed", *near[101:]]
    item = unlike(77, 30)
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "12 !!", None, "s", 5), (None, unlike(1, 40), "en", "s", 1), (None, unlike(1, 40), "de", "t", 1),
        (4, " ".join(near), "en", "s", None), (9, " ".join(other), "en", "s", 1), (7, unlike(2, 50), "en", "s", 2), (7, " ".join(other), "en", "u", 2), (7, unlike(3, 50), None, "s", 2),
        (10, unlike(4, 30), "en", "s", 3), (10, unlike(4, 30), "en", "s", 3), (11, f"{unlike(6, 30)} {item} {unlike(8, 9)}", "en", "s", 1), (None, f"{unlike(9, 30)} {item}", None, None, None),
        (12, unlike(10, 40_000), "en", "s", 1), (13, "!!", "en", "s", 1), (14, "!!", "en", "s", 1),
    ]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("row", "n_lines", "n_dropped", "class_id", "keys", "doc", "node")})
    return table.repartition(3), [r[:2] for r in rows], item


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture()
def sf(spark, tmp_path, odd):
    """A folder with a benchmark and the odd documents."""
    spark.createDataFrame([(1, odd[2]), (2, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd[0].write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stage_names_and_columns(spark, odd, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd[0], sf).columns == odd[0].columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd[0].where("false"), sf).collect() == []


def test_language_stage(spark, sf, monkeypatch):
    rows = [(i, prose(i, 60, lang), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 60)]
    bad = [(900, None, "en", "s", 1), (901, "12 34", "en", "s", 1), (902, "", None, "s", 1), (None, prose(3, 20), None, "s", 1)]
    docs = spark.createDataFrame(rows + bad, DOCS)
    kept = rows_of(corpus_pipeline.language(spark, docs, sf))
    assert kept == Counter((r[0], r[1]) for r in [*rows, bad[3]])
    # nothing to learn from: all with a letter stay
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(bare) is None and rows_of(corpus_pipeline.language(spark, bare, sf)) == kept
    network = langid.learn(docs)
    assert network.least == 0  # all documents were learned from, so none can set a bound
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 25)
    assert 0 < langid.learn(docs).least < 1
    assert langid.accepted(docs, network, 1.01).count() == 0


def test_line_stage(spark, odd, sf):
    line = "one line that many documents have in common, word for word"
    docs = spark.createDataFrame([(i, f"{unlike(i, 9)}\n{line}", "en", "s", 1) for i in range(6)] + [(None, line, "en", "s", 1), (40, None, None, None, None)], DOCS).withColumn("n_lines", F.lit("mine"))
    got = corpus_pipeline.lines(spark, docs, sf)
    assert rows_of(got) == Counter([(i, unlike(i, 9) + (f"\n{line}" if i == 5 else "")) for i in range(6)] + [(None, line), (40, None)])
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) and r["n_lines"] == "mine" for r in got.collect())
    assert rows_of(corpus_pipeline.lines(spark, odd[0], sf)) == Counter(odd[1])


def test_near_duplicate_stage(spark, odd, sf):
    got = rows_of(corpus_pipeline.near_duplicates(spark, odd[0], sf))
    near, other = odd[1][5][1], odd[1][6][1]
    gone = Counter([(None, unlike(1, 40)), (9, other), (7, other), (10, unlike(4, 30)), (14, "!!")])
    assert got == Counter(odd[1]) - gone and got[4, near] == 1


def test_decontamination_stage(spark, odd, sf):
    got = rows_of(corpus_pipeline.decontamination(spark, odd[0], sf))
    assert got == Counter(r for r in odd[1] if odd[2] not in (r[1] or ""))


def test_whole_pipeline(spark, odd, sf):
    pieces = corpus_pipeline.run(spark, sf).collect()
    whole = Counter()
    for p in pieces:
        whole[p["doc_id"]] += p["length"]
    # what has no letter, near and exact copies and the benchmark's passages are gone, all else is packed once
    assert set(whole) == {None, 4, 7, 10, 12}
    texts = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert texts == {None: 1, 4: 1, 7: 2, 10: 1, 12: 1}


def brute_matches(docs, items):
    """All (document, item) within the allowed edits, by the textbook table over whole documents."""
    out = set()
    for (name, text), (item, passage) in itertools.product(docs, items):
        part, words = passage.split(), text.split()
        row = [0] * (len(words) + 1)
        for i, x in enumerate(part):
            new = [i + 1]
            for j, y in enumerate(words):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        if min(row) <= decontam.allowed_edits(len(part)):
            out.add((name, item))
    return out


@pytest.mark.parametrize("kinds", [("insert", "delete", "replace"), ("insert",), ("delete",)])
def test_decontamination_equals_search_over_all_windows(spark, kinds):
    rng = random.Random(23)
    items = [(i, unlike(5000 + i, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 16, 20, 24, 27, 33, 40] * 2)]
    docs = []
    for n in range(3 * len(items)):
        part = items[n % len(items)][1].split()
        for _ in range(decontam.allowed_edits(len(part)) + n // (2 * len(items))):  # a third of them has one edit too many
            kind, at = rng.choice(kinds), rng.randrange(max(1, len(part)))
            part[at : at + 1] = {"insert": [f"x{rng.randrange(10**6)}", *part[at : at + 1]], "delete": [], "replace": [f"x{rng.randrange(10**6)}"]}[kind]
        docs.append((n, f"{unlike(n, rng.randrange(0, 30))} {' '.join(part)} {unlike(9000 + n, rng.randrange(0, 30))}"))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r["doc_id"], r["item_id"]) for r in found.collect()}, brute_matches(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > len(items)


def test_items_of_one_id_and_blocks(spark, monkeypatch):
    a, b = unlike(1, 20), unlike(2, 30)
    docs = spark.createDataFrame([(1, f"{a} {b}"), (1, a), (2, b.replace(b.split()[3], "z")), (None, a), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, a), (5, b), (6, b), (6, b), (None, a)], "item_id long, text string")
    one = sorted((str(r["doc_id"]), r["item_id"], r["distance"], r["item_words"]) for r in decontam.contaminated(docs, bench).collect())
    assert one == [("1", 5, 0, 20), ("1", 5, 0, 20), ("1", 6, 0, 30), ("2", 5, 1, 30), ("2", 6, 1, 30), ("None", 5, 0, 20)]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    monkeypatch.setattr(decontam, "ENTRIES", 3)
    monkeypatch.setattr(decontam, "EMBEDDED", 50)
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"], r["item_words"]) for r in decontam.contaminated(docs, bench).collect()) == one
    assert rows_of(decontam.decontaminate(docs, bench)) == Counter([(3, None)])


def test_walks_reach_the_target():
    assert decontam.walks(3) == 1 and decontam.walks(12) <= decontam.walks(48) <= decontam.MOST_WALKS


def test_heap_is_given_back_before_a_stage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "give_heap_back", lambda s: (seen.append(s), give_heap_back(s)))
    corpus_pipeline.packing(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert seen == [spark]
