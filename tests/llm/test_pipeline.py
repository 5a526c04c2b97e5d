import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from densel.llm import decontamination
from densel.llm.tables import written
from helpers import ALNUM, BLANK, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == names for _, _, after in stages[:-1])


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    insults = set("idiot moron scum loser clown trash pathetic worthless disgusting stupid".split())
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rows = before.select("doc_id", "text").collect()
    plain = [r.doc_id for r in rows if insults & set(words(r.text, r"[a-z]+")) and labels.get(r.doc_id) == 1]
    assert plain and sum(i in kept for i in plain) <= 0.1 * len(plain)
    clean = [i for i, toxic in labels.items() if toxic == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    sets, by = {}, {}
    for r in before.select("doc_id", "text").collect():
        w = words(r.text, BLANK)
        sets[r.doc_id] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        for g in sets[r.doc_id]:
            by.setdefault(g, set()).add(r.doc_id)
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    links = {i: {j for g in s for j in by[g] if j != i and alike(i, j)} for i, s in sets.items()}
    todo = set(sets)
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            i = front.pop()
            group.add(i)
            front |= links[i] - group
        todo -= group
        assert group & kept == {min(group)}


def test_benchmark_passages_go(spark, stages):
    _, before, after = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = words(r.text, ALNUM)
        n = min(13, len(v))
        windows |= {tuple(v[i:i + n]) for i in range(len(v) - n + 1) if v}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    for r in before.select("doc_id", "text").collect():
        w, hit = words(r.text, ALNUM), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
        assert (r.doc_id in kept) == (not (hit and 20 * len(hit) >= len(w)))


def test_mixed_rows_are_sharded(stages):
    _, before, mixed = stages[3]
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies.keys() <= ids and max(copies.values()) <= 3
    out = stages[4][2]
    assert out.count() == mixed.count()
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_extra_columns_with_clashing_names_stay(spark):
    names = ["best", "Score", "copy", "position", "_key", "_id", "_turn", "_text", "_source", "_n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    columns, docs = docs.columns, written(docs, "test-clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert docs.count() > 100
        for c in names:
            assert docs.filter(F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string"))).isEmpty()


def test_decontamination_holds_one_segment_at_a_time(spark, monkeypatch):
    built = []
    build = decontamination.build_index
    monkeypatch.setattr(decontamination, "build_index", lambda *a, **b: built.append(build(*a, **b)) or built[-1])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first().text
    texts = [(i, "word " * decontamination.SEGMENT_WORDS) for i in range(3)] + [(3, item), (4, "clean words"), (4, item + "."), (None, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    after = corpus_pipeline.decontaminate(spark, docs, SF)
    assert sorted((r.doc_id, len(r.text)) for r in after.collect()) == [(i, len(t)) for i, t in texts[:3] + texts[4:5]]
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in built[0].inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert groups == [1] * 4
