"""Small tables with every odd case, and plain versions of the operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(text):
    return WORDS.findall(text or "")


def shingles(text, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, repeats, ties, near copies, a very long text."""
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eta theta iota kappa lam mu nu xi".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    texts = list(base)
    for b in base[:8]:
        w = b.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(999)}"
            texts.append(" ".join(v))
    texts += base[:3] + [None, "", "   \t\n", "one", "one two three", "One TWO three", " nbsp  wide", "é ü \U0001f600 \U0001f600", LONG, LONG + " tail", base[0] + "\n" + base[1] + "\n" + base[0]]
    rows = [(i, t, "en", ["a", "b", None, "cé"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "text without an id", None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def line_budget(n):
    """Edits that op3 allows to the shorter of two lines."""
    return min(5, n // 32 * 32 // 24)


def near(a, b, t):
    """Whether two strings are within t edits: the plain table, but for cells further than t from the diagonal."""
    if abs(len(a) - len(b)) > t:
        return False
    far = t + 1
    row = {j: j for j in range(t + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - t), min(len(b), i + t) + 1):
            row[j] = i if j == 0 else min(last.get(j - 1, far) + (x != b[j - 1]), last.get(j, far) + 1, row.get(j - 1, far) + 1)
        if min(row.values()) > t:
            return False
    return row[len(b)] <= t
