"""Language identification by interpolated Kneser-Ney character models.

One model per language, of ORDER-grams over lower-cased letters; runs of other characters are one space. N-grams are
64-bit hashes in sorted arrays, one array per order for all languages, with a column of final log-probabilities per
language; a second array per order holds the contexts' back-off weights. A text gets the language of the lowest
cross-entropy per character. A text whose cross-entropy lies beyond what held-back training texts of that language
show is rejected. Models are fitted on a bounded sample: about SAMPLE_CHARS characters per language. Executors count the
sample's n-grams and measure the held-back texts; the driver gets distinct n-grams with their counts, and never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from .common import crc_of, need, rows_kept, with_python, without, written
from .grams import codepoints

ORDER = 4
SAMPLE_CHARS, SAMPLE_CHARS_IN_ALL = 3_000_000, 60_000_000
#: Sampling rates, one a language, are broadcast up to this number; more are joined by a shuffle.
FEW_LANGUAGES = 10_000
EDGE, SPACE = 0, 32
CHUNK = 1 << 19
#: Texts with fewer symbols than that may lie further off, by SLACK times as much as their mean varies more.
SURE_LENGTH = 40
SLACK, QUANTILE = 1.2, 0.999
_BASE = np.uint64(0x9E3779B97F4A7C15)
_table: list[np.ndarray] = []


def symbols(text: str, before: int = EDGE) -> np.ndarray:
    """Lower-case letters and single spaces; before is the symbol ahead, so that no space follows a space."""
    if not _table:
        table = np.full(0x33480, SPACE, np.uint32)
        for i in range(0x33480):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _table.append(table)
    points = codepoints(text)
    found = np.where(points < len(_table[0]), _table[0][np.minimum(points, len(_table[0]) - 1)], np.uint32(SPACE))
    space = found == SPACE
    again = np.empty(len(found), bool)
    if len(found):
        again[0] = space[0] and before in (SPACE, EDGE)
        again[1:] = space[1:] & space[:-1]
    return found[~again]


def gram_hashes(ids: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each place from ORDER - 1 on."""
    ids = ids.astype(np.uint64) + np.uint64(1)
    n = len(ids) - ORDER + 1
    out, total, power = [], np.zeros(n, np.uint64), np.uint64(1)
    for k in range(ORDER):
        total = total + ids[ORDER - 1 - k : ORDER - 1 - k + n] * power
        power = np.multiply(power, _BASE)
        out.append(total + np.uint64(k * 0x1000193))
    return out


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


def _padded(texts: list[str]) -> np.ndarray:
    parts = []
    for text in texts:
        parts += [np.zeros(ORDER - 1, np.uint32), symbols(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _grams_at(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the grams that end at each of the places of gram_hashes(), and of those that end one place before."""
    hashes = gram_hashes(np.concatenate([np.zeros(1, ids.dtype), ids]))
    return [h[1:] for h in hashes], [h[:-1] for h in hashes]


#: n: how often; g0, g1, ...: the gram's last symbol, last two, ...; a0, a1, ...: likewise, of what ends before its last symbol.
GRAM_COLUMNS = ("n", *(f"g{n}" for n in range(ORDER)), *(f"a{n}" for n in range(ORDER - 1)))


def gram_table(texts: list[str]) -> dict[str, np.ndarray]:
    """Distinct ORDER-grams of the texts, as GRAM_COLUMNS."""
    ids = _padded(texts)
    if len(ids) < ORDER:
        return {c: np.zeros(0, np.int64 if c == "n" else np.uint64) for c in GRAM_COLUMNS}
    grams, ahead = _grams_at(ids)
    use = np.flatnonzero(ids[ORDER - 1 :] != EDGE)
    _, first, counts = np.unique(grams[-1][use], return_index=True, return_counts=True)
    place = use[first]
    return {"n": counts} | {f"g{n}": grams[n][place] for n in range(ORDER)} | {f"a{n}": ahead[n][place] for n in range(ORDER - 1)}


class Model:
    """grams[n], logp[n]: sorted hashes of (n+1)-grams and a column of log-probabilities per language; contexts[n],
    backoff[n]: likewise for the contexts of (n+1)-grams; unseen: the log-probability of a symbol never seen."""

    def __init__(self, texts: dict[str, list[str]]):
        self._fit({lang: gram_table(held) for lang, held in texts.items()})

    @classmethod
    def of_tables(cls, tables: dict[str, dict[str, np.ndarray]]) -> Model:
        """The model of languages whose tables are as gram_table() makes them."""
        model = cls.__new__(cls)
        model._fit(tables)
        return model

    def _fit(self, tables: dict[str, dict[str, np.ndarray]]) -> None:
        self.languages = sorted(tables)
        stats = [self._counts(tables[lang]) for lang in self.languages]
        alphabet = np.unique(np.concatenate([s[0][0] for s in stats])) if stats else np.zeros(0, np.uint64)
        self.unseen = -np.log(len(alphabet) + 1.0)
        self.grams, self.logp, self.contexts, self.backoff = [], [], [], []
        for n in range(ORDER):
            self._order(n, [s[n] for s in stats])

    @staticmethod
    def _counts(table: dict[str, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """For each order: distinct grams, their counts, their contexts, and their suffixes one shorter. Below the
        highest order a gram counts the distinct symbols ahead of it."""
        out = []
        place = np.arange(len(table["n"]))
        for n in reversed(range(ORDER)):
            keys, first, counts = np.unique(table[f"g{n}"][place], return_index=True, return_counts=True)
            place = place[first]
            none = np.zeros(len(place), np.uint64)
            out.append((keys, (table["n"][place] if n == ORDER - 1 else counts).astype(np.float64), table[f"a{n - 1}"][place] if n else none, table[f"g{n - 1}"][place] if n else none))
        return out[::-1]

    def _order(self, n: int, stats: list[tuple[np.ndarray, ...]]) -> None:
        width = len(self.languages)
        keys, first = np.unique(np.concatenate([s[0] for s in stats]), return_index=True) if stats else (np.zeros(0, np.uint64),) * 2
        context = np.concatenate([s[2] for s in stats])[first] if stats else keys
        suffix = np.concatenate([s[3] for s in stats])[first] if stats else keys
        holders = np.unique(context)
        backoff = np.zeros((len(holders), width))
        chance = np.zeros((len(keys), width))
        if n:
            at, _ = _at(self.grams[n - 1], suffix)
            lower = np.exp(self.logp[n - 1][at].astype(np.float64))
        else:
            lower = np.full((len(keys), width), np.exp(self.unseen))
        where = np.searchsorted(holders, context)
        for k, (own, counts, own_context, _) in enumerate(stats):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2.0 * twos))) if ones else 0.5
            at = np.searchsorted(holders, own_context)
            total = np.bincount(at, weights=counts, minlength=len(holders))
            kinds = np.bincount(at, minlength=len(holders))
            seen = total > 0
            weight = np.ones(len(holders))
            weight[seen] = discount * kinds[seen] / total[seen]
            backoff[:, k] = np.log(weight)
            mine = np.searchsorted(keys, own)
            chance[mine, k] = (counts - discount) / total[at]
            chance[:, k] += weight[where] * lower[:, k]
        self.grams.append(keys)
        self.logp.append(np.log(chance).astype(np.float32))
        self.contexts.append(holders)
        self.backoff.append(backoff.astype(np.float32))

    def _scores(self, n: int, hashes: list[np.ndarray], ahead: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of the symbols at these places under the models of order n + 1."""
        at, hit = _at(self.grams[n], hashes[n][rows])
        out = self.logp[n][at] if len(self.grams[n]) else np.zeros((len(rows), len(self.languages)), np.float32)
        missed = np.flatnonzero(~hit)
        if len(missed):
            places = rows[missed]
            if n:
                where, known = _at(self.contexts[n], ahead[n - 1][places])
                extra = np.where(known[:, None], self.backoff[n][where], 0) if len(self.contexts[n]) else 0
                out[missed] = self._scores(n - 1, hashes, ahead, places) + extra
            else:
                out[missed] = (self.backoff[0][0] if len(self.backoff[0]) else 0) + self.unseen
        return out

    def totals(self, ids: np.ndarray) -> np.ndarray:
        """Cumulated log-probabilities of padded symbols: row i sums the places from ORDER - 1 up to there, edges as 0."""
        hashes, ahead = _grams_at(ids)
        out = self._scores(ORDER - 1, hashes, ahead, np.arange(len(hashes[0])))
        out[ids[ORDER - 1 :] == EDGE] = 0
        return np.cumsum(out, axis=0, dtype=np.float64)

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) mean negative log-probability per symbol, and the number of symbols, 0 if no letter."""
        sums, lengths = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def close() -> None:
            nonlocal group, held
            if group:
                ids = np.concatenate([part for _, part in group])
                totals = np.vstack([np.zeros((1, len(self.languages))), self.totals(ids)])
                at = 0
                for i, part in group:
                    end = at + len(part) - (ORDER - 1)
                    sums[i] -= totals[end] - totals[at]
                    at += len(part)
            group, held = [], 0

        for i, text in enumerate(texts):
            tail, letters, symbols_seen = np.zeros(ORDER - 1, np.uint32), False, 0
            for at in range(0, len(text or ""), CHUNK):
                own = symbols(text[at : at + CHUNK], int(tail[-1]))
                letters = letters or bool((own != SPACE).any())
                symbols_seen += len(own)
                whole = np.concatenate([tail, own])
                group.append((i, whole))
                held += len(whole)
                tail = whole[-(ORDER - 1) :]
                if held >= CHUNK:
                    close()
            lengths[i] = symbols_seen if letters else 0
        close()
        return sums / np.maximum(lengths, 1)[:, None], lengths


def training_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str, chars: int) -> DataFrame:
    """(lang, text, back): whole texts with a language, drawn by a hash at a rate that gives about chars characters each;
    back marks the fifth that is held back."""
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & (F.pmod(crc_of(id_column), F.lit(3)) != 1)).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"), F.col(id_column).cast("string").alias("__sg_id"))
    sizes = written(rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("__sg_chars")), "language-sizes")
    languages = sizes.count()
    each = min(float(chars), SAMPLE_CHARS_IN_ALL / max(1, languages))
    rates = sizes.select("lang", F.least(F.lit(1.0), each / F.greatest("__sg_chars", F.lit(1))).alias("__sg_rate"))
    hashed = lambda salt: F.xxhash64(F.lit(salt), "__sg_id", F.char_length("text"))
    draw = F.pmod(hashed(7), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("__sg_draw", draw).join(F.broadcast(rates) if languages <= FEW_LANGUAGES else rates, "lang").where("__sg_draw < __sg_rate")
    return written(drawn.select("lang", "text", (F.pmod(hashed(8), F.lit(5)) == 0).alias("back")), "language-sample")


def _fitted(sample: DataFrame) -> tuple[Model, np.ndarray] | None:
    """The model, and for each language the cross-entropy beyond which a text is rejected. A fifth of the sample is
    held back to find it; the model returned learns from all. None if there is nothing to learn from."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[str, bool], list[str]] = {}
            for lang, text, back in zip(*[batch.column(c).to_pylist() for c in ("lang", "text", "back")], strict=True):
                groups.setdefault((lang, back), []).append(text)
            for (lang, back), texts in groups.items():
                table = gram_table(texts)
                n = len(table["n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([back] * n, pa.bool_()), *[pa.array(table[c].view(np.int64)) for c in GRAM_COLUMNS]], names=["lang", "back", *GRAM_COLUMNS])

    schema = "lang string, back boolean, " + ", ".join(f"{c} long" for c in GRAM_COLUMNS)
    key = f"g{ORDER - 1}"
    rest = [c for c in GRAM_COLUMNS if c not in ("n", key)]
    grams = sample.mapInArrow(counted, schema).groupBy("lang", key).agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("back"), F.col("n"))).alias("front"), *[F.first(c).alias(c) for c in rest])
    grams = written(grams, "language-grams").toArrow()
    if not grams.num_rows:
        return None
    owner = np.array(grams.column("lang").to_pylist(), object)
    columns = {c: grams.column(c).fill_null(0).to_numpy() for c in (*GRAM_COLUMNS, "front")}

    def model(count: str) -> Model:
        tables = {}
        for lang in sorted(set(owner)):
            at = np.flatnonzero((owner == lang) & (columns[count] > 0))
            tables[lang] = {"n": columns[count][at]} | {c: columns[c][at].view(np.uint64) for c in (key, *rest)}
        return Model.of_tables(tables)

    part = sample.sparkSession.sparkContext.broadcast(model("front"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, length = part.value.cross_entropies(batch.column("text").to_pylist())
            at = [part.value.languages.index(x) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(entropy[np.arange(len(at)), at]), pa.array(length)], names=["lang", "entropy", "length"])

    held = sample.where("back").mapInArrow(measured, "lang string, entropy double, length long").where(F.col("length") >= SURE_LENGTH)
    found = {r["lang"]: r["bound"] for r in held.groupBy("lang").agg(F.percentile("entropy", QUANTILE).alias("bound")).collect()}
    part.destroy()
    whole = model("n")
    return whole, np.array([found[lang] + SLACK if lang in found else np.inf for lang in whole.languages])


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_chars: int = SAMPLE_CHARS, keep_text: bool = True) -> DataFrame:
    """docs plus held_out, lang_pred, score, cross_entropy and rejected, one row for each row of docs.

    Models learn from rows with a language whose crc32(id as text) mod 3 is not 1 (a null id counts as empty text);
    the others are held out. lang_pred is 'und' with score 0, and rejected, where the text is null or has no letter, and
    wherever there was nothing to learn from. score: the chosen language's share among exp(-cross-entropy * symbols),
    symbols counted up to 32. rejected also tells texts beyond the language's bound; lang_pred still names the nearest.
    Of equal cross-entropies the language of the least name counts; repeated rows are judged alike; very long texts are
    read whole, in pieces.
    An empty table gives no rows. Input columns named as an output are replaced. keep_text: false leaves the text out.
    """
    need(docs, id_column, text_column, lang_column)
    outputs = ("held_out", "lang_pred", "score", "cross_entropy", "rejected")
    docs = without(docs, *outputs)
    model = docs.sparkSession.sparkContext.broadcast(_fitted(training_sample(docs, id_column, text_column, lang_column, sample_chars)))
    rows = docs.withColumn("held_out", F.pmod(crc_of(id_column), F.lit(3)) == 1)

    def judged(texts: list[str | None]) -> dict[str, np.ndarray]:
        known, n = model.value, len(texts)
        languages, score, entropy, rejected = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if known is not None and n:
            fitted, bounds = known
            all_entropies, length = fitted.cross_entropies(texts)
            best = all_entropies.argmin(axis=1)
            least = all_entropies[np.arange(n), best]
            share = 1 / np.exp((least[:, None] - all_entropies) * np.minimum(length, 32)[:, None]).sum(axis=1)
            has = length > 0
            languages[has] = np.array(fitted.languages, object)[best[has]]
            score[has], entropy[has] = share[has], least[has]
            loose = SLACK * (np.sqrt(SURE_LENGTH / np.clip(length, 1, SURE_LENGTH)) - 1)
            rejected = ~has | (least > bounds[best] + loose)
        return {"lang_pred": languages, "score": score, "cross_entropy": entropy, "rejected": rejected}

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())]
    return with_python(rows, text_column, judged, fields, keep_text)


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> DataFrame:
    """The rows of docs that identify() does not reject, with docs' columns and their values, whatever their names."""
    need(docs, id_column, text_column, lang_column)
    judged = lambda rows: identify(rows, id_column, text_column, lang_column, **options).where(~F.col("rejected"))
    return rows_kept(without(docs), judged, id_column, text_column, lang_column)
