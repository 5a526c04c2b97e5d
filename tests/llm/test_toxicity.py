import numpy as np
from pyspark.sql import functions as F

from densel.llm import toxicity as t
from helpers import docs


def kernel_map(s):
    """Subsequences of a string with their weights, written out character by character."""
    code = [32, *[int(t._CODES[ord(c)]) if ord(c) < 0x250 else 27 + ord(c) % 5 for c in s], 33]
    out, size = {}, 0.0
    for i in range(len(code)):
        for j in range(i + 1, len(code)):
            for k in range(j + 1, min(len(code), i + t.REACH + 1)):
                if code[i] and code[j] and code[k]:
                    w = t.DECAY ** (k - i + 1)
                    key = (code[i] * t.ALPHABET + code[j]) * t.ALPHABET + code[k]
                    out[key] = out.get(key, 0.0) + w
                    size += w * w
    return {k: v / size ** 0.5 for k, v in out.items()}


def test_kernel():
    strings = ["idiot", "i*d*i*o*t", "a", "", "ab", "élève", "idiot", "日本語", "x" * 24]
    weights = np.random.default_rng(0).normal(size=t.ALPHABET ** 3).astype(np.float32)
    want = [0.5 + sum(weights[k] * v for k, v in kernel_map(s).items()) for s in strings]
    assert np.allclose(t.scored(strings, weights, 0.5), want, atol=1e-4)
    v = t._table(["idiot", "i*d*i*o*t", "i-diot", "window"])
    assert v[0] @ v[2] > 0.6 and v[0] @ v[1] > 0.3 > v[0] @ v[3]


def test_strings():
    assert t.strings_of("You I.D.I.O.T! (idiot), x") == {"you", "i.d.i.o.t", "idiot", "x"}
    assert "idiot" in t.strings_of("an i d i o t here")
    assert t.strings_of(None) == t.strings_of(" \n") == t.strings_of("--- !!!") == set()
    assert all(len(s) <= t.PIECE for s in t.strings_of("x" * 1000 + " " + "y" * 25))


def sample(spark, n=600):
    rng = np.random.default_rng(1)
    syllables = ["ka", "to", "mi", "ne", "ru", "sho", "len", "bar", "dis", "pol"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 60))]
        if i % 6 == 0:
            bad = str(rng.choice(["gwizzler", "quadfex", "vukkoth"]))
            if i % 12 == 0:
                bad += str(rng.choice(syllables))
            if i % 18 == 0:
                bad = bad[:3] + "*" + bad[3:5] + "-" + bad[5:]
            words.insert(int(rng.integers(0, len(words))), bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return docs(spark, rows), spark.createDataFrame([*labels, (3, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")


def test_held_out_texts(spark):
    frame, labels = sample(spark)
    machine = t.fit(frame, labels, F.col("doc_id") % 5 != 0)
    out = t.score_texts(frame, machine)
    assert "text" not in out.columns and "size" in out.columns
    held = [(r.score, r.doc_id % 6 == 0) for r in out.filter("doc_id % 5 = 0").collect()]
    assert np.mean([s >= 0.5 for s, bad in held if bad]) >= 0.9
    assert np.mean([s >= 0.5 for s, bad in held if not bad]) <= 0.03
    extra = docs(spark, [(1, None), (2, ""), (3, "!!!"), (4, "ka " * 50_000), (5, "gwizzler"), (5, "gwizzler"), (None, "g_wizz_ler")])
    got = [(r.doc_id, r.score, r.text) for r in t.score_texts(extra, machine, keep_text=True).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s, _ in got)
    assert {i: s >= 0.5 for i, s, _ in got} == {1: False, 2: False, 3: False, 4: False, 5: True, None: True}


def test_without_a_class(spark):
    frame, labels = sample(spark, 30)
    for marks in (labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.filter("false")):
        assert t.fit(frame, marks, F.lit(True)) is None
    assert {r.score for r in t.score_texts(frame, None).collect()} == {0.0}
    assert t.score_texts(docs(spark, []), None).collect() == []


def test_sure_strings():
    copies = list(range(100, 120))
    texts = [list(range(30)), [*range(20, 60), *copies], copies, copies, [0, 25, 55], [7], [1, 21, 45, 70, 71, 72, 73, 74]]
    assert t._sure(texts, 5).tolist() == [0, 1, 6]


def test_insults_in_a_clean_text(spark):
    frame, labels = sample(spark)
    quoting = F.concat("text", F.lit(" gwizzler quadfex vukkoth"))
    marked = frame.withColumn("text", F.when(F.col("doc_id") == 1, quoting).otherwise(F.col("text")))
    machine = t.fit(marked, labels, F.col("doc_id") % 5 != 0)
    held = [(r.score, r.doc_id % 6 == 0) for r in t.score_texts(frame, machine).filter("doc_id % 5 = 0").collect()]
    assert np.mean([s >= 0.5 for s, bad in held if bad]) >= 0.9
    assert np.mean([s >= 0.5 for s, bad in held if not bad]) <= 0.03


def test_suspects(spark):
    rows = spark.createDataFrame([(130, 1), (130, 130), (1, 0), (3, 1), (0, 5), (9, 1)], "toxic long, clean long")
    got = [r[0] for r in rows.select(t.suspected(F.col("toxic"), F.col("clean"), 0.15, 2000)).collect()]
    assert got == [True, False, True, False, False, True]
