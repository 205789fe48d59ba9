"""Small tables with every awkward case, and plain reference versions of the contracts."""

from __future__ import annotations

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, given as extra columns here.
CLASHES = ["_id", "value", "id", "n", "key", "kind", "size", "rate", "copies", "drop", "lang_pred", "score", "base", "spans", "component_id"]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(seed: int = 5, count: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "tre", "su", "é", "Ö")) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(14) for _ in range(4)]
    rows = []
    for i in range(count):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))
        rows.append([i * 3 % 97, text, rng.choice(("aa", "bb", None)), rng.choice(("s1", "s2", "s3", None)), len(text)])
    for i in range(10, 26):  # exact and near copies
        words = rows[i % 3][1].split(" ")
        if i % 2:
            words[i % len(words)] = "changed"
        rows[i][1] = " ".join(words)
    rows[30][1], rows[31][1], rows[32][1] = None, "", " \n\t \n"
    rows[33][1], rows[34][1], rows[35][1] = "one", "one two three four", "ONE two  three\tfour"
    rows[36][1] = prose(6000)  # very long
    rows[37][1] = "x" * 1500 + "\n" + "ab" * 400
    rows[38][1] = "12 34 !! ?? 😀"
    rows[39][0], rows[39][1] = None, rows[0][1]
    rows.append(list(rows[5]))  # a repeated row
    return [tuple(r) for r in rows]


def frame(spark, rows: list[tuple], extra: bool = True):
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHES:
            df = df.withColumn(name, F.lit("other"))
    return df


def by_id(rows: list[tuple]) -> dict[int, str]:
    """One text per id: the greatest; a null id is the smallest one."""
    out: dict[int, str] = {}
    for row in rows:
        key, text = (-(2**63) if row[0] is None else row[0]), row[1] or ""
        out[key] = max(out.get(key, ""), text)
    return out


def shown(key: int) -> int | None:
    return None if key == -(2**63) else key


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text: str) -> list[str]:
    return [w for w in SPACE.split(lower(text)) if w]


def components(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
