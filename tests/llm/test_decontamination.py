import random
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from densel.llm import decontamination as d
from helpers import ALNUM, docs, words

ITEMS = "item_id long, text string, key string"


def data(seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of"] * 20 + [f"v{i}" for i in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([3, 12, 13, 14, 40])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "---"), (103, "the of"), (2, items[2][1]), (104, items[4][1].upper() + "!"),
              (None, "never counted words"), (105, "Élan vital 42"), (106, "v1")]
    rows = []
    for i in range(60):
        text = some(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = (items[rng.randrange(25)][1] or "").split()
        rows.append((i, rng.choice([" ", ", ", "\n", " - "]).join(text)))
    return [*rows, (60, None), (61, ""), (62, "..."), (63, "ÉLAN élan vital 42"), (None, items[5][1]), (7, items[3][1]),
            (64, "the " * 50_000 + items[6][1])], items


def brute(text, items, window):
    w, hit, found = words(text, ALNUM), set(), set()
    for key, other in items:
        v = words(other, ALNUM)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if v and key is not None else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("passes", [1, 3])
def test_against_brute_force(spark, monkeypatch, passes):
    rows, items = data()
    if passes > 1:
        monkeypatch.setattr(d, "PASS_WORDS", 2000)
    index = d.build_index(docs(spark, rows))
    out = d.search(index, spark.createDataFrame([(*x, "k") for x in items], ITEMS), 13)
    got = sorted((str(r.key), r.n_words, r.n_hit, r["items"]) for r in out.withColumn("n_hit", d.n_hit(out.spans)).collect())
    small = [x for x in items if words(x[1], ALNUM)]
    assert got == sorted((str(i), *brute(t, small if i != 64 else small, 13)) for i, t in rows)


def test_spans_and_near_items(spark):
    items = spark.createDataFrame([(1, "a b c d e", "k"), (2, "x y z", "k")], ITEMS)
    rows = [(1, "q a b c d e f a b c d e"), (2, "a q b c d e"), (3, "e d c b a"), (4, "a b c"), (5, "x"), (6, "x q y z")]
    index = d.build_index(docs(spark, rows))
    got = {r.key: r for r in d.search(index, items, 5, slop=1).collect()}
    assert [(s.start, s.end) for s in got["1"].spans] == [(1, 6), (7, 12)] and got["1"]["items"] == ["1"]
    assert got["2"]["items"] == [] and got["2"].near_items == ["1"]
    assert got["3"].near_items == [] and got["4"].near_items == [] and got["5"].near_items == []
    assert got["6"].near_items == ["2"]


def test_empty(spark):
    nothing = spark.createDataFrame([], ITEMS)
    assert d.search(d.build_index(docs(spark, [])), nothing).collect() == []
    got = d.search(d.build_index(docs(spark, [(1, "a b")])), nothing).collect()
    assert [(r.key, r.n_words, r.spans, r["items"]) for r in got] == [("1", 2, [], [])]


def segment(rows):
    keys, texts = zip(*rows, strict=True)
    return list(d._index(iter([pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.binary())], ["key", "text"])])))


def test_a_segment_is_a_row_group(spark):
    rows = [(i, "a b c d e " * (d.SEGMENT_WORDS // 5)) for i in range(4)]
    index = d.build_index(docs(spark, rows).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in index.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert [g.num_rows for g in groups] == [1] * 4
    assert max(g.total_byte_size for g in groups) < 5 * d.SEGMENT_WORDS
    items = spark.createDataFrame([(1, "d e a b", "k")], ITEMS)
    got = [(r.key, r.n_words, r["items"], r.spans[0].start) for r in d.search(index, items, 4).collect()]
    assert sorted(got) == [(str(i), d.SEGMENT_WORDS, ["1"], 3) for i in range(4)]


def test_workers_get_few_texts_and_one_segment_at_a_time(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[str(b.nbytes)]])] + [pa.array([b""], pa.binary())] * 5, names)

    def counted(names, windows, slop, batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(b.num_rows)]), pa.array([0]), *[pa.array([[]], t) for t in kinds]], columns)

    names, columns, kinds = d._SEGMENT.names, d._MATCHES.names, [f.type for f in d._MATCHES][2:]
    rows = docs(spark, [(0, "")]).select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("doc_id"), F.repeat(F.lit("word "), 300_000).alias("text"))
    with monkeypatch.context() as m:
        m.setattr(d, "_index", sizes)
        told = [int(r["keys"][0]) for r in d.build_index(rows.coalesce(1)).collect()]
    assert sum(told) > 12 * 1_500_000 and max(told) < d.TEXT_BYTES + 2_000_000
    index = d.build_index(rows.coalesce(1)).coalesce(1)
    assert index.count() == 3
    monkeypatch.setattr(d, "_search", counted)
    assert [r.key for r in d.search(index, spark.createDataFrame([(1, "a", "k")], ITEMS)).collect()] == ["1"] * 3


def test_memory_of_a_search_does_not_follow_its_postings():
    rng = random.Random(1)
    text = " ".join(rng.choices([f"w{i}" for i in range(30)], k=300_000)).encode()
    index = segment([("1", text), ("2", None), ("3", text[:900_000])])
    windows = d._windows([("a", b" ".join(text.split()[1000:2500])), ("b", text[500:600])], 13)
    assert len(windows[13][0]) > 1400  # each one's rarest term has about 15000 postings
    tracemalloc.start()
    out = [r for b in d._search(["a", "b"], windows, 0, iter(index)) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["key"], r["items"]) for r in out] == [("1", ["a", "b"]), ("2", []), ("3", ["a", "b"])]
    assert [(s["start"], s["end"]) for s in out[0]["spans"]][-1] == (1000, 2500) and out[0]["spans"] == out[2]["spans"]
    assert most < 80_000_000


def test_texts_without_words_and_many_short_ones():
    assert [r["n_words"] for b in d._search([], {}, 0, iter(segment([("1", b""), (None, None), ("2", b"--")]))) for r in b.to_pylist()] == [0, 0, 0]
    rows = [(str(i), b"x y z" if i % 3 else b"z y") for i in range(60_000)]
    out = [r for b in d._search(["k", "l"], d._windows([("k", b"y z"), ("k", b"x")], 2), 0, iter(segment(rows))) for r in b.to_pylist()]
    assert [r["key"] for r in out] == [k for k, _ in rows]
    assert all([(s["start"], s["end"]) for s in r["spans"]] == ([(0, 3)] if int(r["key"]) % 3 else []) for r in out)
