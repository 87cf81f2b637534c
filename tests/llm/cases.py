"""Awkward documents: nulls in every column, blank and long texts, ties, repeated rows, clashing columns."""

import random

EXTRA = "key string, n string, id string, fp string, k string, rank string, length string, ids string, t string, label string, starts string, kept string, lang_pred string, recipe string, n_replaced string, c string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
TAIL = ("x",) * len(EXTRA.split(", "))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "nd", "Éa", "ti"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, out = prose(60).split(), prose(45), []
    out += [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b ", None), (4, "one", "en"), (5, "ONE", None), (6, "one two three", "fr"), (7, "a b c d", "en")]
    out += [(8, "é" * 30 + "　x y z", None), (9, "12345 !!! ,,, 678", "de"), (10, "don't  we'll\r\n\r\n  stop 中文 \U0001f600 <|endoftext|>", "en")]
    for k in range(70):  # near copies with more and more changed words
        words = base[:]
        for _ in range(k // 10):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append((100 + k, " ".join(words), "en"))
    out += [(200, " ".join(base), "en"), (201, " ".join(base).upper(), "en"), (202, " ".join(base).replace(" ", "\n"), "en")]
    for k in range(12):
        out.append((300 + k, f"{prose(30 + k)} {passage} {prose(25)}", "en"))
    out += [(400, " ".join([passage] * 3), "en"), (401, prose(6000), "fr"), (402, "la la la " * 400, "es"), (403, "x" * 3000, None)]
    out += [(500, prose(50), "de"), (500, prose(50), "de")]  # one id, two texts
    out += [(501, "same same but same", "de"), (501, "same same but same", "de")]  # a repeated row
    return out


def rows() -> list[tuple]:
    return [(i, t, lang, None if (i or 0) % 2 else "src", None if t is None else len(t), *TAIL) for i, t, lang in texts()]


def frame(spark, with_null_id: bool = False):
    return spark.createDataFrame(rows() + ([(None, "no id " * 30, None, None, None, *TAIL)] if with_null_id else []), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return [x.decode() for x in (text or "").encode().split()]


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
