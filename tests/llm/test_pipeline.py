import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import secret_scan, toxicity, winnow
from inkwell.llm.queries import table
from inkwell.llm.text import learned_fold

SF = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first stage and after each."""
    docs, out = table(spark, SF, "documents"), {}
    out["raw"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out[name] = docs
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(steps):
    for name in ("toxicity", "near_duplicates", "decontamination", "secrets"):
        assert steps[name].dtypes == steps["raw"].dtypes


def test_one_of_each_group_stays(steps):
    from tests.llm.test_near_dup import brute_classes

    before = {r.doc_id: r.text for r in steps["toxicity"].collect()}
    assert set(ids(steps["near_duplicates"])) == set(brute_classes(steps["raw"].sparkSession, before).values())


def test_contaminated_documents_go(steps):
    items = [r.text for r in table(steps["raw"].sparkSession, SF, "benchmark").collect()]
    wanted = []
    for r in steps["near_duplicates"].collect():
        hit, n = winnow.hit_words(r.text, items), len(winnow.Words([r.text.encode()]))
        if not (hit and 20 * len(hit) >= n):
            wanted.append(r.doc_id)
    assert ids(steps["decontamination"]) == sorted(wanted)


def test_secrets_are_replaced(steps):
    before = {r.doc_id: r for r in steps["decontamination"].collect()}
    after = {r.doc_id: r for r in steps["secrets"].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not secret_scan.base_spans(r.text)
        if not secret_scan.base_spans(before[i].text):
            assert r.text == before[i].text


def test_encoding(steps):
    assert steps["sentencepiece"].where(~F.col("round_trip")).count() == 0
    assert set(ids(steps["sentencepiece"])) == set(ids(steps["secrets"]))


def test_toxic_documents_go(spark, steps):
    """Those that the same classifier calls toxic, scored word by word."""
    model = toxicity.fitted(steps["raw"], table(spark, SF, "labels"), learned_fold)
    kept = set(ids(steps["toxicity"]))
    for r in steps["raw"].collect():
        words = {w: h for w, h in zip(*(lambda w: ([w.word(i) for i in range(len(w))], w.hash.tolist()))(winnow.Words([r.text.encode()])), strict=True)}
        score = model.bias + sum(float(model.weight[h % toxicity.BUCKETS]) for h in {h % toxicity.BUCKETS: h for h in words.values()}.values())
        assert (score < 0) == (r.doc_id in kept) or abs(score) < 1e-3


def test_run_gives_the_same(spark, steps):
    digest = lambda df: hashlib.sha256(repr(sorted((r.doc_id, r.sample, r.ids) for r in df.collect())).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SF)) == digest(steps["sentencepiece"])


def test_heaps_are_given_back(spark):
    """Before each stage the executors (here the driver) collect all garbage, whatever the stage does."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in full)
        stage(spark, docs, SF)
        assert sum(b.getCollectionCount() for b in full) > before, name


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "token=abcdefgh1234 and more", "en", "s", 27), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "clean text " * 3, None, None, 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        if name == "near_duplicates":
            assert docs.count() == 3  # null and empty texts are copies of each other
    kept = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert kept[None] == ("[REDACTED] and more", 19) and kept[4] == ("clean text " * 3, 33)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 8  # three of two texts each, two of the empty one


def test_clashing_columns_stay(spark):
    """Columns named like those that operators add go through all stages as they are."""
    added = ["score", "spans", "items", "predicted", "contaminated", "n_words", "n_hit", "hit_spans", "node", "id", "row", "label", "__text", "__k0", "new", "Doc_Id"]
    docs = table(spark, SF, "documents").select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in added])
    first = docs
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).persist()
            assert docs.dtypes == first.dtypes, name
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in added)
        assert stage is not corpus_pipeline.STAGES[-1][1] and corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[0] == "doc_id"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
