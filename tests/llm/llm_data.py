"""Small inputs with the odd cases every operator must take."""
import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that clash with names the operators use
EXTRA = ", size long, fp long, root long, score double, `row` long, votes string, ids string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ("the of and to in th er on an ing ed re ti at sh tion ble ha ou st").split()
    out = []
    while len(out) < words:
        n = rng.randint(5, 12)
        s = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
        s[rng.randrange(n)] = rng.choice(("the", "of", "and", "to", "in"))
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:words])


def odd_docs():
    """Nulls everywhere, empty and blank, very long, equal and repeated rows."""
    long_text = prose(99, 60_000)
    rows = [(i, prose(i, 20 + i)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, long_text), (24, "x" * 50_000),
             (30, rows[3][1]), (31, rows[3][1]), (31, rows[3][1]), (None, rows[4][1]),
             (None, None), (40, "naïve Ünïcode 中文 é́   \x1f end"),
             (41, "one two three"), (42, "one two three four")]
    return [(d, t, "en" if i % 5 else None, f"src{i % 3}" if i % 4 else None,
             None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


def frame(spark, rows=None, extra=False):
    rows = odd_docs() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, DOC_SCHEMA)
    return spark.createDataFrame([(*r, None, 1, None, 2.0, None, "v", None) for r in rows],
                                 DOC_SCHEMA + EXTRA)
