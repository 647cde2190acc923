"""Language identification with spans of mixed-language text.

Script ranges narrow the languages a word can have; byte n-gram models learned from labelled documents score the rest;
Viterbi over a document's words, with a penalty for each switch of language, labels the spans. The prediction is the
language with most letters, its score the share of the document's letters that it has.

The model is learned from at most about `LANGUAGE_ROWS` labelled rows of each language, drawn by a hash of their ids
over the whole table, so a language that is rare in a large table is learned from all its rows; counts are combined in
tasks before they are shuffled, and the model has `BUCKETS` numbers per language.

Cases: null, empty and letterless texts are `und` with score 0. A text whose scripts no learned language uses gets the
language that its n-grams fit best, with a score of FOREIGN at most; beside words of a learned script such words do not
count. Rows without a label teach nothing; ties go to the first language by name; repeated rows and other columns are
kept as they are, but `identify` replaces columns named like its results; with nothing learned all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilark.llm.common import bytes_of, pieces, ranges, stored, unit_hash, words_of
from vigilark.llm.decontaminate import if_small

BUCKETS = 1 << 15
GRAMS = (2, 3)  # bytes
SWITCH_PENALTY = 12.0
LANGUAGE_ROWS = 5_000  # training rows of a language, at most about
FOREIGN = 0.1  # weight of the letters of texts in scripts that no learned language uses
PIECE_BYTES = 8 << 20  # text that a task works on at once
RARE_SCRIPT = 0.001  # a language uses a script when this share of its words is written in it
# fixed values: first code points of script ranges and the script that starts there ("" for none)
SCRIPTS = (
    (0x0, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xAA, "Latin"), (0xAB, ""), (0xBA, "Latin"),
    (0xBB, ""), (0xC0, "Latin"), (0xD7, ""), (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"), (0x2B9, ""),
    (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"),
    (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "Nko"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"),
    (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"),
    (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, "Yi"),
    (0xA640, "Cyrillic"), (0xA700, "Latin"), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x40000, ""),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})  # "" comes first


@dataclass
class LanguageModel:
    """Log chances of n-gram buckets (one row each, a zero row last) and used scripts, one column per language."""

    languages: list[str]
    log_chance: np.ndarray
    uses_script: np.ndarray


def _scripts_of(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(script of each word's first letter, number of letters); script 0 where a word has no letter."""
    data, offsets = bytes_of(names)
    lengths = np.diff(offsets)
    lettered = (data | 32) - np.uint8(97) < 26
    before = np.concatenate([[0], np.cumsum(lettered)])
    letters = before[offsets[1:]] - before[offsets[:-1]]
    first = np.where(letters > 0, SCRIPT_NAMES.index("Latin"), 0)
    wide = np.concatenate([[0], np.cumsum(data > 127)])
    other = np.flatnonzero(wide[offsets[1:]] > wide[offsets[:-1]])
    if len(other):  # words that are not plain ASCII
        words = names.take(pa.array(other))
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        starts = np.array([p for p, _ in SCRIPTS], dtype=np.uint32)
        codes = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)
        script = codes[np.searchsorted(starts, points, side="right") - 1]
        owner = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy(zero_copy_only=False))
        has = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
        found, at = np.zeros(len(words), np.int64), np.flatnonzero(script > 0)[::-1]
        found[owner[at]] = script[at]
        n = np.bincount(owner, weights=script > 0, minlength=len(words)).astype(np.int64)
        first[other], letters[other] = np.where(has, found, 0), np.where(has, np.maximum(n, 1), 0)
    return first, letters


def _buckets(names: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """n-gram buckets at each byte of the marked words for each n (BUCKETS: none), and each word's first place."""
    data, offsets = bytes_of(names)
    lengths = np.diff(offsets)
    starts = offsets[:-1] + 2 * np.arange(len(names))
    marked = np.full(len(data) + 2 * len(names), 2, np.uint32)
    marked[starts + lengths + 1] = 3
    marked[ranges(starts + 1, lengths)] = data
    left = np.repeat(starts + lengths + 2, lengths + 2) - np.arange(len(marked))  # places to the word's end
    found, code = [], marked.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code << np.uint32(8)
        code[: len(code) - n + 1] |= marked[n - 1:]
        if n in GRAMS:
            spread = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            found.append(np.where(left >= n, spread, np.uint32(BUCKETS)))
    return found, starts


def fit_languages(labelled: DataFrame, language_rows: int = LANGUAGE_ROWS) -> LanguageModel:
    """Model from text and lang of about `language_rows` of the rows of each language (all, if there are no more)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, most_bytes=PIECE_BYTES):
                langs = part.column("lang").to_pylist()
                ids, names, offsets = words_of(part.column("text"))
                if not len(names):
                    continue
                found, starts = _buckets(names)
                script, _ = _scripts_of(names)
                lengths = np.diff(np.append(starts, len(found[0])))
                for lang in sorted(set(langs)):
                    own = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                    n = np.bincount(ids[own], minlength=len(names)).astype(np.float64)
                    at = np.repeat(n, lengths)
                    total = grams.setdefault(lang, np.zeros(BUCKETS + 1 + len(SCRIPT_NAMES)))
                    for b in found:
                        total[: BUCKETS + 1] += np.bincount(b, weights=at, minlength=BUCKETS + 1)
                    total[BUCKETS + 1:] += np.bincount(script, weights=n, minlength=len(SCRIPT_NAMES))
        for lang, total in grams.items():
            total[BUCKETS] = 0
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(seen), pa.string()), "bucket": pa.array(seen, pa.int64()),
                "n": pa.array(total[seen].astype(np.int64))})

    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    shares = if_small(stored(
        rows.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(language_rows)) / F.count("*")).alias("_share")), "language-shares"))
    drawn = (F.col("lang") == F.col("_lang")) & (unit_hash("languages", "doc_id") < F.col("_share"))
    rows = rows.join(shares, drawn).select("text", "lang")
    parts = rows.mapInArrow(counts, "lang string, bucket long, n long")
    total = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(total["lang"].unique())
    table = np.zeros((BUCKETS + 1 + len(SCRIPT_NAMES), len(languages)))
    if languages:
        table[total["bucket"], np.searchsorted(languages, total["lang"])] = total["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS + 1:]
    chance = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    uses = scripts >= RARE_SCRIPT * np.maximum(scripts[1:].sum(0), 1)
    return LanguageModel(languages, np.vstack([chance, np.zeros((1, len(languages)))]).astype(np.float32), uses)


def word_scores(model: LanguageModel, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each word in each language, letters of each word, whether any language uses its script)."""
    script, letters = _scripts_of(names)
    scores = np.zeros((len(names), len(model.languages)), np.float32)
    step = max(1, 400_000 // max(4, len(model.languages)))
    for at in range(0, len(names), step):
        found, starts = _buckets(names.slice(at, step))
        for b in found:
            scores[at:at + step] += np.add.reduceat(model.log_chance[b], starts, axis=0)
    allowed = model.uses_script[script] & (script > 0)[:, None]
    known = allowed.any(1)
    scores -= scores.max(1, keepdims=True)
    scores = np.where(allowed | ~known[:, None], scores, -60.0)
    return scores.astype(np.float32), letters, known


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; documents of a batch advance together, longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, by_length = offsets[:-1][order], lengths[order]
    longest = int(by_length[0]) if len(order) else 0
    active = np.searchsorted(-by_length, -np.arange(longest), side="left")
    state = np.zeros((len(order), scores.shape[1]), np.float32)
    switched = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    for t in range(longest):
        k = active[t]
        at, now = starts[:k] + t, state[:k]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(k), top][:, None] - np.float32(penalty)
            better = jump > now
            switched[at], best[at] = better, top
            now = np.where(better, jump, now)
            now -= now.max(1, keepdims=True)
        state[:k] = now + scores[at]
    labels, label = np.zeros(len(scores), np.int16), state.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at, now = starts[:k] + t, label[:k]
        labels[at] = now
        label[:k] = np.where(switched[at, now], best[at], now)
    return labels


def _label(model: LanguageModel, texts: pa.Array, penalty: float, spans: bool) -> dict[str, pa.Array]:
    n, n_langs = len(texts), len(model.languages)
    ids, names, offsets = words_of(texts)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    if n_langs and len(names):
        scores, letters, known = word_scores(model, names)
        used = np.bincount(rows, weights=known[ids], minlength=n) > 0
        foreign = ~known[ids] & ~used[rows] & (letters[ids] > 0)
        own = scores[ids]
        own[~known[ids] & ~foreign] = 0.0
        labels = viterbi(own, offsets, penalty)
        weight = np.where(known[ids] | foreign, letters[ids], 0)
        by_lang = np.bincount(rows * n_langs + labels, weights=weight, minlength=n * n_langs).reshape(n, n_langs)
        total = np.bincount(rows, weights=letters[ids], minlength=n)
        main = by_lang.argmax(1)
        share = by_lang[np.arange(n), main] / np.maximum(total, 1) * np.where(used, 1.0, FOREIGN)
    else:
        labels, share, main = np.zeros(len(ids), np.int16), np.zeros(n), np.zeros(n, np.int64)
    predicted = np.where(share > 0, np.array([*model.languages, "und"], object)[np.where(share > 0, main, n_langs)], "und")
    out = {"lang_pred": pa.array(predicted.tolist(), pa.string()), "score": pa.array(share, pa.float64())}
    if spans:
        new = np.ones(len(ids), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new) if n_langs else np.zeros(0, np.int64)
        stop = np.append(first[1:], len(ids))[: len(first)]
        items = pa.StructArray.from_arrays(
            [pa.array(first - offsets[rows[first]]), pa.array(stop - first),
             pa.array([model.languages[i] for i in labels[first]], pa.string())], ["first_word", "n_words", "lang"])
        per_row = np.bincount(rows[first], minlength=n)
        out["lang_spans"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()), items)
    return out


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score and, if asked, lang_spans (first word, number of words, language)."""
    new = "lang_pred string, score double" + (
        ", lang_spans array<struct<first_word:long,n_words:long,lang:string>>" if spans else "")
    names = [x.split()[0] for x in ("lang_pred", "score", "lang_spans")]
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most_bytes=PIECE_BYTES):
                made = _label(model, part.column("text"), penalty, spans)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *made.values()], names=[*part.schema.names, *made.keys()])

    schema = StructType(list(kept.schema))
    for field in kept.sparkSession.createDataFrame([], new).schema:
        schema = schema.add(field)
    return kept.mapInArrow(run, schema)


def in_fold(folds: int) -> "F.Column":
    """Remainder of a document's fold, from its id as text; null ids are empty texts."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """docs whose main language holds at least `least` of their letters; same columns. Rejects `und`."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score", "lang_spans")}
    flagged = identify(docs.withColumnsRenamed(aside), model)
    kept = flagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
