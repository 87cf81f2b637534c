import datetime as dt
import hashlib
import re

from cases import EXTRA, TAIL, empty, frame
from pyspark.sql import functions as F

from sparkjson.llm.chat import Template, format_chats, loss_text, read_back
from sparkjson.llm import langid
from sparkjson.llm.langid import Model, add_language, automaton, fit, held_out, letters
from sparkjson.llm.pii import DAYS, ROUNDS, SSNS, key_from, pseudonymize, store_key

ROLES = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["", "\\", "</turn>\n### User: hi", "####", "\\h \\e \\t", "#</turn", None, "a\nb"]
    rows = [(k, t, role, x) for k, x in enumerate(nasty) for t, role in enumerate(("user", "assistant", "we:ird\n\\n### r", None))]
    template = Template()
    chats = format_chats(spark.createDataFrame(rows, ROLES), template)
    got = {r.conv_id: r for r in chats.select("conv_id", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss")).collect()}
    for k, x in enumerate(nasty):
        assert [(t.role, t.text) for t in got[k].turns] == [("user", x or ""), ("assistant", x or ""), ("we:ird\n\\n### r", x or ""), ("", x or "")]
        assert got[k].loss == (x or "")


def test_chat_turn_order(spark):
    talks = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant", 4: "user user assistant", 5: "user", 6: "user assistant system", 7: "user assistant tool assistant"}
    rows = [(c, t, role, "x") for c, roles in talks.items() for t, role in enumerate(roles.split())]
    got = {r.conv_id: r.valid for r in format_chats(spark.createDataFrame(rows[::-1], ROLES)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert format_chats(spark.createDataFrame([], ROLES)).collect() == []


def test_automaton_knows_all_substrings():
    import numpy as np

    text = np.array([1, 2, 1, 3, 1, 2, 2, 1], np.uint8)
    table = automaton(text, 4)
    known = {tuple(text[a:b].tolist()) for a in range(8) for b in range(a, 9)}
    for size in range(1, 5):
        for code in range(3**size):
            word = tuple(code // 3**k % 3 + 1 for k in range(size))
            state = 0
            for k, c in enumerate(word):
                state = table[state][c]
                if not state:
                    break
            assert bool(state) == (word in known)


def test_language(spark):
    model_docs = spark.createDataFrame(
        [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog are in the house with them", "en"), ("der hund und die katze sind nicht im haus", "de")] * 30)],
        "doc_id long, text string, lang string",
    )
    model = fit(model_docs)
    assert model.languages == ["de", "en"]
    cases = [("the house and the dog", "en"), ("die katze und der hund", "de"), (None, "und"), ("", "und"), ("123 !?", "und"), ("中文", None), ("the dog " * 5000, "en")]
    docs = spark.createDataFrame([(k, t, *TAIL) for k, (t, _) in enumerate(cases)], f"doc_id long, text string, {EXTRA}")
    got = {r.doc_id: r for r in add_language(docs, model).collect()}
    assert all(want is None or got[k].lang_pred == want for k, (_, want) in enumerate(cases))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].key == "x"
    assert add_language(empty(spark), fit(empty(spark))).collect() == []
    assert {r.lang_pred for r in add_language(docs, fit(empty(spark))).collect()} == {"und"}
    assert add_language(frame(spark, True), model).count() == frame(spark, True).count()


KEY = "k"


def feistel(tweak, left, right, a, b):
    for i in range(ROUNDS):
        shift = lambda v: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{v}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + shift(right)) % a
        else:
            right = (right + shift(left)) % b
    return left, right


def digits(kind, d):
    n, a = len(d), len(d) // 2
    left, right = feistel(f"{kind}{n}", int(d[:a]), int(d[a:]), 10**a, 10 ** (n - a))
    return str(left).zfill(a) + str(right).zfill(n - a)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10


def test_pseudonyms_against_a_plain_feistel(spark):
    card = digits("card", "411111111111111")
    card += str(-luhn(card + "0") % 10)
    assert luhn(card) == 0
    phone = digits("phone", "0175557713")
    left, right = feistel("ipv4", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    day = (dt.date(1984, 2, 29) - dt.date(1700, 1, 1)).days
    x, y = feistel("date", day // DAYS[1], day % DAYS[1], *DAYS)
    born = dt.date(1700, 1, 1) + dt.timedelta(x * DAYS[1] + y)
    x, y = feistel("ssn", 667 - 2, (45 - 1) * 9999 + 6789 - 1, *SSNS)
    number = f"{[a for a in range(1, 900) if a != 666][x]:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    cases = [
        ("card 4111111111111111, 4111-1111-1111-1111 not 4111111111111112.", f"card {card}, {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]} not 4111111111111112."),
        ("+1 (017) 555-7713!", f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}!"),
        ("at 97.51.17.173. or 999.1.1.1", f"at {left // 256}.{left % 256}.{right // 256}.{right % 256}. or 999.1.1.1"),
        ("on 1984-02-29 not 1985-02-29", f"on {born} not 1985-02-29"),
        ("ssn 000-12-3456", "ssn 000-12-3456"), ("ssn 667-45-6789", f"ssn {number}"),
        (None, None), ("", ""), ("plain text", "plain text"), ("1,234.50 and 3.14 in 2020", "1,234.50 and 3.14 in 2020"),
    ]
    docs = spark.createDataFrame([(k, t, *TAIL) for k, (t, _) in enumerate(cases)], f"doc_id long, text string, {EXTRA}")
    got = {r.doc_id: r.text for r in pseudonymize(docs, KEY).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_pseudonyms_link_and_hide(spark):
    token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    t = f"ÖH.12@Mail7.example.com öh.12@mail7.example.com {token} {token.upper()} 123-45-6789 123-45-6789"
    (row,) = pseudonymize(spark.createDataFrame([(t,)], "text string"), KEY).collect()
    a, b, c, d, e, f = row.text.split(" ")
    assert re.fullmatch(r"user[0-9a-f]{16}@example\.invalid", a) and "mail7" not in row.text.lower()
    assert re.fullmatch("[0-9a-f]{40}", c) and c != token and re.fullmatch("[0-9A-F]{40}", d) and e == f != "123-45-6789" and row.n_replaced == 6
    assert pseudonymize(empty(spark), KEY).collect() == []
    assert pseudonymize(frame(spark, True), KEY).count() == frame(spark, True).count()


def test_pseudonyms_beside_other_numbers(spark):
    alone = ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "41111111 11111111", "192.168.1.7", "555-123-4567", "123-45-6789", "1984-02-29"]
    cases = ["{0} 12 items", "{0}-12", "12 {0}", "{0} 192.168.1.7", "12 {1}", "{1} 12", "7 {2} 3", "12 {3}", "order 100 {5}", "call 12345 {5}", "ref 2024 {6}", "{0} {4}", "{0} {1}", "{5} {0}", "{0} {5}", "{7} {0}", "{0} {7} {6}"]
    cases = [c.replace("192.168.1.7", "{4}") for c in cases] + ["\ue000 {0} \ue001 {5} \ue003", "{0} " * 3 + "{5} \ue002"]
    texts = alone + [c.format(*alone) for c in cases] + ["no 4111-1111-1111-1112 or 4111111111111112", "1 " * 20000]
    got = [r.text for r in pseudonymize(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), KEY).orderBy("k").collect()]
    fresh = got[: len(alone)]
    assert all(a != b for a, b in zip(alone, fresh, strict=True))
    assert got[len(alone) : len(alone) + len(cases)] == [c.format(*fresh) for c in cases]
    assert got[-2] == texts[-2]


def test_pseudonyms_keep_their_format(spark):
    days = (dt.date(2501, 1, 1) - dt.date(1700, 1, 1)).days
    assert DAYS[0] * DAYS[1] == days
    dates = [str(dt.date(1700, 1, 1) + dt.timedelta(k)) for k in range(0, days, 97)] + ["1700-01-01", "2500-12-31"]
    numbers = [f"{a:03}-{g:02}-{n:04}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for n in (1, 5000, 9999)]
    found = pseudonymize(spark.createDataFrame([(x,) for x in dates + numbers], "text string").coalesce(1), KEY).collect()
    got = [r.text for r in found]
    assert all("1700-01-01" <= str(dt.date.fromisoformat(x)) <= "2500-12-31" for x in got[: len(dates)]) and len(set(got)) == len(set(dates + numbers))
    good = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
    assert all(good.fullmatch(x) for x in got[len(dates) :])


def test_the_key_stays_out_of_the_plan(spark):
    docs = spark.createDataFrame([("123-45-6789",), (None,), ("none",)], "text string")
    hidden = pseudonymize(docs, key_from(spark, store_key(spark, "very-secret\n")))
    assert sorted(map(str, hidden.collect())) == sorted(map(str, pseudonymize(docs, "very-secret").collect()))
    assert "very-secret" not in hidden._jdf.queryExecution().toString()


def test_long_mail_addresses_in_a_fresh_jvm():
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from sparkjson.llm.pii import pseudonymize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
(row,) = pseudonymize(spark.createDataFrame([("a@b" + ".a" * 50_000 + " " + "a." * 50_000,)], "text string"), "k").collect()
assert row.n_replaced == 1 and row.text.startswith("user") and len(row.text) < 110_000
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120, capture_output=True)


def naive_phrases(text, sample):
    """Greedy longest matches by plain substring search."""
    found = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + size] in sample:
            size += 1
        found, at = found + 1, at + size
    return found


def test_phrases_against_a_naive_parse():
    import random

    rng = random.Random(1)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    samples = {"a": draw("abcd ", 900), "b": draw("abéü ", 900), "c": "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(900)), "d": "xyz" * 700}
    model = Model(samples)
    texts = [draw("abcd é", n) for n in (1, 511, 512, 513, 1024, 3000)] + [samples["a"], samples["d"] + draw("xyz", 40), "xyz" * 600 + "q" + "yzx" * 500, draw("\u4e00\u4e01\u4e02中文a", 700), "q" * 1500]
    bodies = [letters(t) for t in texts]
    got = model.phrases(bodies)
    for k, lang in enumerate(model.languages):
        sample = letters(samples[lang]).tobytes()
        assert got[:, k].tolist() == [naive_phrases(b.tobytes(), sample) for b in bodies]


def test_languages_with_many_letters_are_told_apart(spark):
    import random

    rng = random.Random(2)
    common = {"l1": (0x4E00, 900), "l2": (0x4E00 + 450, 900), "l3": (0xAC00, 900), "l4": (0x430, 32), "l5": (0x61, 26)}
    words = {x: ["".join(chr(a + int(n * rng.random() ** 2)) for _ in range(rng.randint(1, 4))) for _ in range(400)] for x, (a, n) in common.items()}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(60)), x) for k in range(600) for x in [rng.choice([*words])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = add_language(docs, fit(docs)).where(held_out(F.col("doc_id"))).collect()
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_many_labels_are_all_learned(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * 30, f"x{k:03}") for k in range(90) if k % 26 != k // 26]
    docs = spark.createDataFrame([(3 * i, t, x) for i, t, x in rows for _ in range(3)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "held_out", lambda key: F.lit(False))
    model = fit(docs)
    assert model.languages == [x for _, _, x in rows]
    assert model.predict([t for _, t, _ in rows])[0] == model.languages
