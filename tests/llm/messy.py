"""Small tables with everything that may be wrong with one."""

import random

#: Extra columns whose names operators use inside.
EXTRA = "shard int, body string, doc long, row string, v long, n long, bucket int, kept string, label int, path string, score double, id long"
COLUMNS = f"doc_id long, text string, {EXTRA}"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, 4, 5, "z", 6, "p", 0.5, 7) for i, t in rows], COLUMNS)


def prose(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def texts():
    """(id, text): copies, near copies, shared passages, nulls, blanks, repeated rows and one long text."""
    base, passage = prose(1, 80), prose(2, 60)
    edited = base.split()
    edited[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(edited)), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "One  two")]
    rows += [(10, f"{prose(3, 30)}\n{passage} {prose(4, 30)}"), (11, f"{prose(5, 20)} {passage}"), (12, passage), (None, base), (None, None)]
    rows += [(13, prose(6, 12)), (13, prose(6, 12)), (14, prose(7, 20_000, 50_000)), (15, "é漢字 ▁ 😀 x" * 3), (-5, prose(8, 40)), (16, prose(8, 40))]
    rows += [(100 + k, " ".join([*prose(9, 70).split()[:60], f"end{k}", *prose(9, 9).split()])) for k in range(12)]
    return rows
