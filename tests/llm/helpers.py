from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    """Texts with exact copies, near copies, shared passages, repeats within, nulls, empty and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Élan", "naïve", "日本", "a\u00a0b"]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = make(50)
    out: list[str | None] = [None, "", " \t\n", "one", "one two three four", "One TWO three four", "x " * 120, " ".join(make(3000))]
    while len(out) < n:
        kind = r.random()
        if kind < 0.2 and len(out) > 12:
            out.append(r.choice(out[8:]))
        elif kind < 0.5 and len(out) > 12:
            near = words(r.choice(out[8:]))
            for _ in range(r.randint(1, 6)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append(" ".join(near))
        elif kind < 0.7:
            out.append(" ".join(make(r.randint(0, 40)) + passage[r.randint(0, 10) :] + make(r.randint(0, 40))))
        else:
            out.append(r.choice([" ", "\n", " \t "]).join(make(r.randint(1, 150))))
    return list(enumerate(out))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: dict[str, str] | None = None):
    """A documents table; extra adds columns of constant strings."""
    from pyspark.sql import functions as F

    full = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in rows]
    out = spark.createDataFrame(full, SCHEMA)
    for name, value in (extra or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out
