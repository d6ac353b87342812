"""Language identification by interpolated Kneser-Ney character models.

Training counts the character n-grams of every labelled text (not of a sample): tasks count their own texts
first, and what is shuffled is a row per n-gram, language and task. Lower orders are continuation counts, made
from the order above. The interpolated probability of every observed n-gram is worked out once and stored in
one sorted array of hashes for each order, with a column for each language, so that scoring is a search in
sorted arrays. A text's language is the one with the lowest cross-entropy per character. It is rejected if that
entropy is far above what labelled texts of the language have: their mean or 99.9th percentile plus a margin, of
all labelled texts that the model tells right. A language with fewer than ``few_texts`` of them has learnt too
little to know its own spread: its limit is the widest of all languages, its own included, plus 4 bits by the
root of its texts' number, so every language has one (but if no labelled text is told right, none is rejected).

The model is broadcast. Its size is bounded: of each order, each language keeps the n-grams that are found as
often as the least power of two that ``max_grams`` of them or fewer reach (all, where they are no more). That is
a share of the corpus, so more texts of the same kind keep the same n-grams. Counts, continuation counts and
contexts' totals are of all n-grams: what isn't kept leaves its weight to the order below, to which it backs off.
More than ``max_langs`` languages are refused.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without any training
text every text is ``und``; rows without a label don't train. Repeated rows are judged one by one. Texts are
read as a whole, in pieces of bounded size that leave no trace in the result. Other columns are ignored, or kept
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import write_table

UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20
_BITS = 12
_FLOOR = -16.0  # log2 probability of a character that no language has


def code_pieces(text: str, carry: int) -> Iterator[np.ndarray]:
    """Lower-cased letters, hashed to 12 bits; whatever stands between letters is one 0, as are both ends.

    A long text comes in pieces, each of which begins with the last ``carry`` codes of the one before; so the runs
    of carry + 1 codes that pieces hold are those of the whole text.
    """
    size = _PIECE
    kept, cut = np.zeros(0, np.int64), False  # cut: whether the codes so far end within what stands between letters
    for at in range(0, max(1, len(text)), size):
        piece = text[at : at + size].replace("Σ", "σ").lower()  # the one letter that is lower-cased by what follows it
        spaced = _RUNS.sub("\0", f"{'' if at else chr(0)}{piece}{'' if at + size < len(text) else chr(0)}")
        if cut and spaced.startswith("\0"):
            spaced = spaced[1:]
        if not spaced:
            continue
        c = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = np.concatenate((kept, np.where(c < 4096, c, 1 + (c * 2654435761 >> 7) % 4095)))
        cut = spaced.endswith("\0")
        yield found
        kept = found[max(0, len(found) - carry) :]


def codes(text: str) -> np.ndarray:
    """All codes of a text."""
    return np.concatenate(list(code_pieces(text, 0)))


def grams(chars: np.ndarray, order: int) -> np.ndarray:
    """The hash of each run of ``order`` characters: its 12-bit characters side by side."""
    n = max(0, len(chars) - order + 1)
    out = np.zeros(n, np.int64)
    for k in range(order):
        out = (out << _BITS) | chars[k : k + n]
    return out


def count_grams(labelled: DataFrame, order: int) -> DataFrame:
    """lang, gram, n over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple] = {}
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).extend(grams(x, order) for x in code_pieces(text, order - 1))
            for lang, found in parts.items():
                new = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
                counts[lang] = _add(counts[lang], new) if lang in counts else new
            if sum(len(g) for g, _ in counts.values()) > 4_000_000:
                yield from _rows(counts)
                counts = {}
        yield from _rows(counts)

    rows = labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _add(a: tuple, b: tuple) -> tuple:
    keys, where = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return keys, np.bincount(where, np.concatenate((a[1], b[1])), len(keys)).astype(np.int64)


def _rows(counts: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    for lang, (g, n) in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def _search(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in a sorted array, and which of them are there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """For each order, from 1 on: sorted hashes; log2 probabilities; log2 back-off weights as a context."""

    langs: list[str]
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    limits: dict[str, float] = field(default_factory=dict)

    def log2(self, chars: np.ndarray) -> np.ndarray:
        """For each character but the first, its log2 probability in each language, after those before it."""
        score = np.zeros((len(chars), len(self.langs)), np.float32)
        todo = np.arange(1, len(chars))
        for order in range(len(self.orders), 0, -1):
            fits = todo[todo >= order - 1]
            hashes, logp, _ = self.orders[order - 1]
            at, seen = _search(hashes, grams(chars, order)[fits - (order - 1)])
            score[fits[seen]] += logp[at[seen]]
            rest = fits[~seen]
            if order > 1 and len(rest):
                contexts, _, backoff = self.orders[order - 2]
                at, known = _search(contexts, grams(chars, order - 1)[rest - (order - 1)])
                score[rest[known]] += backoff[at[known]]
            elif order == 1:
                score[rest] += _FLOOR
            todo = np.concatenate((todo[todo < order - 1], rest))
        return score[1:]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and its characters."""
        bits, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        queue: list[tuple[int, np.ndarray, int]] = []
        held, carry = 0, len(self.orders) - 1
        for i, text in enumerate(texts):
            known = 1  # codes of a piece that aren't predicted: the first 0, or those of the piece before
            for piece in code_pieces(text, carry):
                queue.append((i, piece, known))
                known = min(len(piece), carry)
                held += len(piece)
                if held >= _PIECE // 4:
                    self._score(queue, bits, sizes)
                    queue, held = [], 0
        self._score(queue, bits, sizes)
        return bits / np.maximum(sizes, 1)[:, None], sizes

    def _score(self, queue: list, bits: np.ndarray, sizes: np.ndarray) -> None:
        """Adds some pieces' bits to their texts' ones. A text's first 0 follows the last 0 of the one before."""
        if queue:
            starts = np.cumsum([0, *(len(c) for _, c, _ in queue)])[:-1]
            score = np.concatenate((np.zeros((1, len(self.langs)), np.float32), self.log2(np.concatenate([c for _, c, _ in queue]))))
            for start, (_, _, known) in zip(starts, queue, strict=True):
                score[start : start + known] = 0
            sums = np.add.reduceat(score, starts, axis=0, dtype=np.float64)
            np.subtract.at(bits, [i for i, _, _ in queue], sums)
            np.add.at(sizes, [i for i, _, _ in queue], [len(c) - known for _, c, known in queue])

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int]]:
        """(language, score, bits per character, characters) of each text."""
        real = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        out: list = [(UND, 0.0, None, 0)] * len(texts)
        entropy, sizes = self.entropies([texts[i] for i in real])
        for i, h, n in zip(real, entropy, sizes, strict=True):
            best = int(h.argmin())
            out[i] = (self.langs[best], float(1 / np.exp2(-(h - h[best]) * min(int(n), 64)).sum()), float(h[best]), int(n))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits per character, rejected) of each text."""
        return [(x, score, bits, bits is None or bits > self.limits.get(x, np.inf) + 4 / np.sqrt(n)) for x, score, bits, n in self.score(texts)]


def _contexts(g: np.ndarray, n: np.ndarray, total: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of sorted n-grams: hashes, totals over all n-grams, weights left to the order below."""
    ctx, first = np.unique(g >> _BITS, return_index=True)
    if not len(g):
        return ctx, np.zeros(0), np.zeros(0)
    total, kinds = total[first], np.diff(np.append(first, len(g)))
    return ctx, total, (total - np.add.reduceat(n, first) + discount * kinds) / total


def build_model(tables: list[dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]], discount: float = 0.75) -> Model:
    """The model of, for each order from 1 on, {language: (sorted n-grams, their counts, their contexts' totals)}."""
    order, langs = len(tables), sorted(tables[-1])
    model = Model(langs)
    for k, table in enumerate(tables, 1):
        own = [g for g, *_ in table.values()]
        contexts = [g >> _BITS for g, *_ in tables[k].values()] if k < order else []
        keys = np.unique(np.concatenate([*own, *contexts])) if langs else np.zeros(0, np.int64)
        p = np.zeros((len(keys), len(langs)))
        backoff = np.zeros((len(keys), len(langs)))
        if k > 1:
            below, lower = model.orders[-1][0], np.exp2(model.orders[-1][1].astype(np.float64))
            at, _ = _search(below, keys & ((1 << (_BITS * (k - 1))) - 1))
            found = below[at] == keys & ((1 << (_BITS * (k - 1))) - 1)
            lower = np.where(found[:, None], lower[at], 2.0**_FLOOR)
        for j, lang in enumerate(langs):
            g, n, total = table[lang]
            mine = np.zeros(len(keys))
            mine[np.searchsorted(keys, g)] = n
            ctx, totals, weights = _contexts(g, n, total, discount)
            at, known = _search(ctx, keys >> _BITS)
            c = np.where(known, totals[at], 1) if len(ctx) else np.ones(len(keys))
            spare = np.where(known, weights[at], 1.0) if len(ctx) else np.ones(len(keys))
            if k == 1:
                p[:, j] = np.maximum(np.maximum(mine - discount, 0) / c + spare * 2.0**_FLOOR, 2.0**_FLOOR)
            else:
                p[:, j] = np.maximum(mine - discount, 0) / c + spare * lower[:, j]
        if k < order:
            for j, lang in enumerate(langs):
                ctx, _, weights = _contexts(*tables[k][lang], discount)
                backoff[np.searchsorted(keys, ctx), j] = np.log2(weights)
        model.orders.append((keys, np.log2(np.maximum(p, 2.0**-60)).astype(np.float32), backoff.astype(np.float32)))
    return model


def _gram_tables(labelled: DataFrame, order: int, max_grams: int, max_langs: int) -> list[dict[str, tuple]]:
    """build_model()'s tables. Counts and totals are of all n-grams; those that are kept pass the driver."""
    highest = write_table(count_grams(labelled, order), "grams")
    names = [r["lang"] for r in highest.select("lang").distinct().limit(max_langs + 1).collect()]
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages; no more are modelled")
    counts = [highest]
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * k)) - 1))
        counts.insert(0, counts[0].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")))
    tables = []
    for table in counts:
        size = F.length(F.bin("n")) - 1  # of the power of two
        sizes = table.groupBy("lang", size.alias("size")).agg(F.count("*").alias("grams")).collect()  # 64 a language at most
        least = {}
        for lang in names:
            mine = {r["size"]: r["grams"] for r in sizes if r["lang"] == lang}
            least[lang] = next(1 << t for t in range(65) if sum(v for k, v in mine.items() if k >= t) <= max_grams)
        context = F.shiftright("gram", _BITS)
        totals = table.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        bound = F.lit(1)
        for lang, t in least.items():
            bound = F.when(F.col("lang") == lang, F.lit(t)).otherwise(bound) if t > 1 else bound
        kept = table.filter(F.col("n") >= bound).withColumn("context", context).join(totals, ["lang", "context"])
        found = kept.select("lang", "gram", "n", "total").toArrow()
        tables.append({})
        for lang in names:
            mine = found.filter(pc.equal(found.column("lang"), lang)).sort_by("gram")
            tables[-1][lang] = tuple(mine.column(x).to_numpy().astype(np.int64) for x in ("gram", "n", "total"))
    return tables


def _limits(scored: DataFrame, langs: list[str], few_texts: int) -> dict[str, float]:
    """The bits per character beyond which texts are rejected, from all labelled texts (lang and _SCORES' columns): a row
    a language passes the driver."""
    seen = scored.filter("bits is not null and lang_pred = lang")
    step = F.ceil((F.col("bits") - 4 / F.sqrt("n_coded")) * 64)
    # exact counts by 64ths of a bit (some thousands a language), so the percentile doesn't depend on how tasks merge
    bins = seen.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("bits").cast("decimal(20,12)")).alias("bits"))
    over = Window.partitionBy("lang")
    bins = bins.withColumn("texts", F.sum("n").over(over)).withColumn("upto", F.sum("n").over(over.orderBy("step")))
    top = F.min(F.when(F.col("upto") >= 0.999 * F.col("texts"), F.col("step"))) / 64
    at = bins.groupBy("lang").agg(F.first("texts").alias("texts"), (F.sum("bits").cast("double") / F.first("texts")).alias("mean"), top.alias("top")).collect()
    own = {r["lang"]: max(r["mean"] + 1.5, r["top"] + 0.75) for r in at}
    texts = {r["lang"]: r["texts"] for r in at}
    enough = [limit for x, limit in own.items() if texts[x] >= few_texts] or [*own.values()]
    if not enough:
        return {}
    return {x: own[x] if texts.get(x, 0) >= few_texts else max(*enough, own.get(x, 0.0), 0.0) + 4 / np.sqrt(texts.get(x, 1)) for x in langs}


def learn(labelled: DataFrame, order: int = 4, max_grams: int = 250_000, max_langs: int = 100) -> Model:
    """A model, without limits, of the rows of (text, lang) that have both."""
    if order * _BITS > 60:
        raise ValueError("a hash holds five characters at most")
    return build_model(_gram_tables(labelled.filter("text is not null and lang is not null"), order, max_grams, max_langs))


def fit(labelled: DataFrame, order: int = 4, max_grams: int = 250_000, max_langs: int = 100, few_texts: int = 30) -> Model:
    """A model of the rows of (text, lang) that have both, with limits."""
    model = learn(labelled, order, max_grams, max_langs)
    model.limits = _limits(_scored(labelled.filter("text is not null and lang is not null").select("text", "lang"), model, "lang"), model.langs, few_texts)
    return model


_SCORES = "lang_pred string, score double, bits double, n_coded long"


def _scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep and _SCORES' columns for every row of docs, which has a column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), _SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column("text").to_pylist())
            columns = zip(*found, strict=True) if found else ((),) * 4
            types = [pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keep, "lang_pred", "score", "bits", "n_coded"]
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _rejected(limits: dict[str, float]) -> Column:
    bits = F.col("bits")
    if not limits:
        return bits.isNull()
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return bits.isNull() | F.coalesce(bits > F.try_element_at(known, "lang_pred") + 4 / F.sqrt("n_coded"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, bits (cross-entropy per character), rejected for every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return _scored(rows, model, id_col).withColumn("rejected", _rejected(model.limits)).drop("n_coded")


def learn_and_identify(docs: DataFrame, learns: str, *keep: str, few_texts: int = 30) -> DataFrame:
    """keep, lang_pred, score, bits, rejected for every row of docs (text, lang, a boolean ``learns``, and keep).

    The model and its limits are those of the rows that learn and have a label; every text is scored once, for the
    limits and for itself.
    """
    mine = F.col(learns) & F.col("lang").isNotNull()
    model = learn(docs.filter(mine).select("text", "lang"))
    # a label is only kept where it may be learnt from
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.when(mine, F.col("lang")).alias("lang"), "text")
    scored = write_table(_scored(rows, model, *[f"keep_{c}" for c in keep], "lang"), "scores")
    limits = _limits(scored.filter("lang is not null"), model.langs, few_texts)
    return scored.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "lang_pred", "score", "bits", _rejected(limits).alias("rejected"))


def drop_unknown(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_broadcast: int = 500_000) -> DataFrame:
    """docs without the rows whose text a model of the labelled ones rejects.

    A verdict hangs on the text alone, so it is carried by the text's digest; those of rejected texts are broadcast
    up to max_broadcast of them (16 bytes each), and joined beyond it. Null texts go.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.lit(True).alias("learns"), F.unhex(F.md5(text)).alias("digest"))
    found = learn_and_identify(rows, "learns", "digest")
    gone = write_table(found.filter("rejected and digest is not null").select("digest").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    packed = docs.filter(text.isNotNull()).select(F.struct("*").alias("row"))
    return packed.join(gone, F.unhex(F.md5(F.col(f"row.`{text_col}`").cast("string"))) == F.col("digest"), "left_anti").select("row.*")


def fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds held_out: whether the id's crc32 is divisible by 5. Rows without an id are held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 5 == 0)
