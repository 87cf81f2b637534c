"""Language identification by cross-parsing against suffix automata.

Fit: for each language a suffix automaton of a bounded sample of labelled text.  Predict: a text is parsed greedily
into the longest phrases that occur in the language's sample; the language whose phrases, times the logarithm of its
sample's size, are the fewest for each byte wins.  Texts are parsed as the UTF-8 bytes of their lower-cased letters,
with one space for all that stands between letters, so every letter of every language counts and each automaton needs only the bytes that its sample has.

The fit counts the labels of all rows, takes for each language and each of up to ``SLOTS`` hash slots the row with the
smallest hash, and uses at most ``MAX_BYTES`` bytes of these texts, or an even share of ``ALL_BYTES`` where there are more
languages than have room for that.  Every label is learned; more than ``MAX_LABELS`` are an error, since they can be no languages.

Prediction covers whole texts.  They are cut into blocks of ``BLOCK`` bytes only to parse many at once: each block is
parsed from its first byte, then the parse of the block before it goes on into it until both start a phrase at the same
byte, from which on they agree.  The phrases are those of one parse from the text's first byte to its last.

Null text, or text without a letter: ``und`` with score 0.  Ties: the language that sorts first.  Without labelled
rows every text is ``und``.  Repeated rows are predicted one by one, alike; a null doc_id is predicted but never learned
from.  Very long texts are many blocks.  Extra columns are carried along by ``add_language`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SLOTS, MAX_BYTES, ALL_BYTES, MAX_LABELS, BLOCK = 48, 20_000, 1_280_000, 65_536, 512
#: Bytes that one step of the prediction takes at most (and one text at least), rows that are unpacked at once, and languages that are parsed at once.
STEP_BYTES, STEP_ROWS, STEP_LANGUAGES = 1_000_000, 512, 8
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text's lower-cased letters, with one space for each run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):
        letter[points == p] = chr(p).isalpha()
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    kept = np.where(letter, points, 32)[keep].astype("<u4")
    return np.frombuffer(kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)


class Model:
    """One automaton for each language, in one table; a language's column 0 is for bytes that its sample lacks."""

    def __init__(self, samples: dict[str, str], most_bytes: int = MAX_BYTES):
        self.languages = sorted(samples)
        bodies = [letters(samples[x])[:most_bytes] for x in self.languages]
        self.column = np.zeros((len(bodies), 256), np.int64)
        tables = []
        for k, body in enumerate(bodies):
            known = np.unique(body)
            self.column[k, known] = np.arange(1, len(known) + 1)
            tables.append(automaton(self.column[k][body], len(known) + 1))
        self.width = np.array([t.shape[1] for t in tables], np.int64)
        self.base = np.cumsum([0, *(t.size for t in tables)])[:-1].astype(np.int64)
        self.table = np.concatenate([t.ravel() for t in tables]).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.weight = np.array([np.log2(max(2, len(b))) for b in bodies])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); a byte that a language lacks is a phrase of its own."""
        flat = np.concatenate(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([np.arange(e - len(t), e, BLOCK) for t, e in zip(texts, ends, strict=True)]).astype(np.int64)
        owner = np.searchsorted(ends, starts, "right")
        sizes = np.minimum(BLOCK, ends[owner] - starts)
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(self.languages), STEP_LANGUAGES):
            own = slice(k, k + STEP_LANGUAGES)
            out[:, own] = self._phrases(flat, starts, sizes, owner, len(texts), own)
        return out

    def _phrases(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int, own: slice) -> np.ndarray:
        base, width, column, table = self.base[own], self.width[own], self.column[own], self.table
        order = np.argsort(-sizes, kind="stable")
        first, longest = starts[order], -sizes[order]
        state = np.zeros((len(base), len(starts)), np.int64)
        begins = np.zeros((len(base), len(flat)), bool)
        roots = base[:, None]
        for j in range(int(-longest[0]) if len(longest) else 0):
            live = int(np.searchsorted(longest, -j, "left"))
            at, old = first[:live] + j, state[:, :live]
            c = column[:, flat[at]]
            to = table[roots + old * width[:, None] + c]
            none = to == 0
            begins[:, at] = none | (old == 0)
            state[:, :live] = np.where(none, table[roots + c], to)
        at_end = np.empty_like(state)
        at_end[:, order] = state
        out = np.zeros((n, len(base)))
        for k in range(len(base)):
            out[:, k] = np.add.reduceat(begins[k], starts[np.flatnonzero(np.diff(owner, prepend=-1))], dtype=np.int64)
        # The parse of each block goes on into the next one, until both begin a phrase at one byte.
        before = np.flatnonzero(owner[1:] == owner[:-1])
        lang, block = np.repeat(np.arange(len(base)), len(before)), np.tile(before, len(base))
        now, again = at_end[lang, block], set()
        for j in range(BLOCK):
            inside = j < sizes[block + 1]
            lang, block, now = lang[inside], block[inside], now[inside]
            if not len(lang):
                break
            at = starts[block + 1] + j
            c = column[lang, flat[at]]
            to = table[base[lang] + now * width[lang] + c]
            begin, other = (to == 0) | (now == 0), begins[lang, at]
            np.add.at(out, (owner[block], lang), begin.astype(np.int64) - other)
            stay = ~(begin & other)
            now = np.where(to == 0, table[base[lang] + c], to)[stay]
            lang, block = lang[stay], block[stay]
        # A phrase longer than a whole block in the midst of a text: parsed once more, byte by byte.
        midst = block + 2 < len(owner)
        for k, b in zip(lang[midst].tolist(), block[midst].tolist(), strict=True):
            if owner[b + 2] == owner[b]:
                again.add((k, int(owner[b])))
        for k, text in again:
            blocks = np.flatnonzero(owner == text)
            body = flat[starts[blocks[0]] : starts[blocks[-1]] + sizes[blocks[-1]]]
            out[text, k] = self._one_by_one(body, own.start + k)
        return out

    def _one_by_one(self, body: np.ndarray, k: int) -> int:
        part = self.table[self.base[k] : self.base[k + 1] if k + 1 < len(self.base) else None]
        width, state, found = int(self.width[k]), 0, 0
        for c in self.column[k][body].tolist():
            to = int(part[state * width + c])
            if not to or not state:
                found += 1
            state = to or int(part[c])
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo: list[tuple[int, np.ndarray]] = []
        held = 0

        def run() -> None:
            if todo:
                bits = self.phrases([s for _, s in todo]) * self.weight / np.array([[len(s)] for _, s in todo])
                best = bits.argmin(1)
                for (k, _), row, b in zip(todo, bits, best, strict=True):
                    others = np.delete(row, b)
                    names[k] = self.languages[b]
                    scores[k] = float(1 - row[b] / others.min()) if len(others) else 1.0
                todo.clear()

        for k, text in enumerate(texts):
            s = letters(text) if text else np.zeros(0, np.uint8)
            if self.languages and (s != 32).any():
                todo.append((k, s))
                held += len(s)
                if held > STEP_BYTES:
                    run()
                    held = 0
        run()
        return names, scores


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the suffix automaton; 0 is the root and stands for none."""
    table, link, length, last = [[0] * width], [-1], [0], 0
    for c in symbols.tolist():
        new, p = len(table), last
        table.append([0] * width)
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and not table[p][c]:
            table[p][c] = new
            p = link[p]
        if p >= 0:
            q = table[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(table)
                table.append(table[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and table[p][c] == q:
                    table[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array(table, np.int64)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows that are not held out; the sample's bound is in the module's docstring."""
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    labels = [r["lang"] for r in known.select("lang").distinct().limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not labels:
        return Model({})
    most, slots = min(MAX_BYTES, max(64, ALL_BYTES // len(labels))), max(1, min(SLOTS, MAX_LABELS // len(labels)))
    slot = F.pmod(F.xxhash64("k"), F.lit(slots)).alias("slot")
    chosen = known.groupBy("lang", slot).agg(F.min_by("k", F.xxhash64("k", F.lit(5))).alias("k")).select("lang", "k")
    # At most MAX_LABELS rows or so are chosen, and no more than ``most`` characters of each are read.
    sample = known.join(F.broadcast(chosen), ["lang", "k"]).select("lang", "k", F.substring("t", 1, most).alias("t"))
    parts: dict[str, list[str]] = {}
    for r in sample.orderBy("k", "t").collect():
        parts.setdefault(r["lang"], []).append(r["t"] or "")
    samples = {}
    for x, p in parts.items():
        share = max(1, most // len(p))
        body = " ".join(t[: 2 * share] for t in p)[:most]
        if any(c.isalpha() for c in body):
            samples[x] = body
    return Model(samples, most)


def add_language(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``carry`` (all by default), then language and score under the names ``into``, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if carry is None else carry) if c not in into]

    @F.arrow_udf(f"{into[0]} string, {into[1]} double")
    def predict(texts: pa.Array) -> pa.Array:
        found, scores = [], []
        for at in range(0, len(texts), STEP_ROWS):
            some = shared.value.predict(texts.slice(at, STEP_ROWS).to_pylist())
            found += some[0]
            scores += some[1]
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], list(into))

    # Only the texts travel to Python and only the results travel back.  Called nondeterministic so that a filter on the
    # result does not predict once more.
    return docs.select(*names, predict.asNondeterministic()(text).alias("__found")).select(*names, "__found.*")


def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return add_language(docs, fit(docs), carry=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
