"""The pipeline over planted cases, and its stages one by one."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import FIELDS

WORDS = [f"w{i}" for i in range(3000)]


@pytest.fixture
def planted(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(120):  # clean ones, and every fourth of the labelled ones toxic
        words = prose(rng.randint(60, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    copy, near, leak = clean[3], clean[5], prose(40)
    rows += [(1001, copy[1], "s0"), (1002, copy[1].replace(" ", "\n", 3), "s1"), (1003, near[1] + " tail", "s2"), (1004, near[1] + " tail end", None),
             (1005, " ".join(prose(30) + leak[20:] + prose(5) + leak[:20] + prose(30)), "s1"), (1006, None, "s1"), (1007, "", "s2"), (1008, " ", None),
             (1009, " ".join(prose(50) + bad * 3), "s0")]
    for name, data, schema in (("documents", [(a, t, "en", s, len(t or "")) for a, t, s in rows], FIELDS), ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", [(1, " ".join(leak)), (2, None)], "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {r[0] for r in clean} | {1008}
    return str(tmp_path), rows, kept, near[0]


def test_pipeline(spark, planted):
    sf_dir, rows, kept, near = planted
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(got) == len({r.doc_id for r in got}) == len(kept)
    assert {r.doc_id for r in got} == kept
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), abs=2)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_stages_keep_the_columns_and_work_on_what_is_left(spark, planted):
    sf_dir, rows, kept, near = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    # 30 toxic and one unlabelled toxic; two copies and two of three empty texts; two near copies; one leak.
    assert sizes == [len(rows) - 31, len(rows) - 35, len(rows) - 37, len(rows) - 38]


def test_rows_without_or_with_repeated_doc_id(spark, docs, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    a, b, c, d, leak, lone = prose(60), prose(60), prose(60), prose(60), prose(30), prose(30)
    rows = [(None, a), (None, a), (None, a.replace(" ", "  ", 2)), (None, b), (None, b + " tail"), (7, c), (7, d), (7, d + " tail"), (7, d), (8, c),
            (None, prose(20) + " " + leak), (7, prose(20) + " " + leak), (9, prose(20) + " " + lone), (None, None), (None, " ")]
    spark.createDataFrame([(1, leak), (None, lone)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    exact = corpus_pipeline.drop_exact_copies(spark, docs(rows), "")
    want = [r for i, r in enumerate(rows) if i not in (0, 1, 8, 9, 13, 14)]
    left = sorted((str(x), t) for x, t in want)
    assert [x for x in got(exact) if x[1].strip()] == left and exact.count() == len(left) + 1
    near = got(corpus_pipeline.drop_near_copies(spark, docs(rows), ""))
    assert len([x for x in near if x[1].strip()]) == 7 and len(near) == 9
    assert [x for x, t in near if t.split()[:10] == c.split()[:10]] == ["7"]
    clean = corpus_pipeline.drop_leaks(spark, docs(rows), str(tmp_path))
    assert clean.columns == docs(rows).columns and got(clean) == sorted((str(x), t or "") for i, (x, t) in enumerate(rows) if i not in (10, 11, 12))


def test_pipeline_of_empty_tables(spark, planted, tmp_path):
    sf_dir, *_ = planted
    none = f"{tmp_path}/none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_near_copies_are_cut_at_five_words_and_four_fifths(spark, docs):
    words = [f"u{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]
    # 86 of 106 shingles of five words are shared, 0.811 (and 89 of 105 of four words); two words more make it 86 of 108, 0.796.
    above = docs([(1, " ".join(words)), (2, " ".join(changed))], clashing=False)
    below = docs([(1, " ".join(words)), (2, " ".join(changed + ["y0", "y1"]))], clashing=False)
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, above, "").collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, below, "").collect()) == [1, 2]
