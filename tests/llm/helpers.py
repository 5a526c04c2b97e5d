"""Brute force in plain Python that the operators are held against."""

import re

BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, pattern=BLANK):
    return re.findall(pattern, (text or "").translate(LOWER))


def components(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with a column of a clashing name."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7) for r in rows]
    return spark.createDataFrame(full, DOCS + ", size int")
