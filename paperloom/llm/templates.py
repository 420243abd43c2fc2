"""Benchmark decontamination by template windows and slot consistency.

Numbers, names and units become typed placeholders, so a question whose
values were exchanged keeps its windows. Windows of documents meet those of
benchmark items in a hash join; of documents only windows are shuffled that a
bitmap of fixed size lets pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix, prefix_sums, spread, substring_hash, words
from .common import bitmap_of, in_bitmap, stored, text_of

WINDOW = 5
COVERAGE = 0.8
#: Slots that may break the mapping of an item's values to a document's, as a share.
MAX_CONFLICTS = 0.2
# Words that count as units.
UNITS = (
    "%", "amp", "amps", "bytes", "cent", "cents", "cm", "day", "days", "degree", "degrees", "dollar", "dollars", "euro", "euros", "feet", "foot", "ft", "g", "gallon", "gallons", "gb",
    "gram", "grams", "h", "hour", "hours", "hz", "inch", "inches", "j", "joule", "joules", "kb", "kg", "kilogram", "kilograms", "kilometer", "kilometers", "km", "kw", "l", "lb", "lbs",
    "liter", "liters", "litre", "litres", "m", "mb", "meter", "meters", "metre", "metres", "mg", "mile", "miles", "min", "minute", "minutes", "ml", "mm", "month", "months", "mph",
    "ounce", "ounces", "oz", "percent", "pound", "pounds", "s", "second", "seconds", "ton", "tons", "volt", "volts", "w", "watt", "watts", "week", "weeks", "yard", "yards", "year", "years",
)
# Capitalised words that are no names, as they open sentences.
COMMON = (
    "a", "after", "all", "although", "an", "and", "are", "as", "at", "because", "before", "both", "but", "by", "calculate", "can", "compute", "consider", "determine", "did", "do", "does",
    "each", "every", "explain", "find", "for", "from", "given", "he", "her", "his", "how", "i", "if", "in", "is", "it", "its", "let", "many", "my", "no", "not", "of", "on", "one", "or",
    "our", "she", "show", "since", "so", "some", "suppose", "than", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "two", "was", "we", "were", "what",
    "when", "where", "which", "while", "who", "why", "with", "write", "you", "your",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "er", "es", "ich", "ihr", "mit", "sie", "und", "von", "was", "wenn", "wer", "wie", "wir", "zu",
    "au", "ce", "ces", "dans", "du", "elle", "et", "il", "ils", "je", "la", "le", "les", "nous", "on", "par", "pour", "quand", "que", "quel", "quelle", "qui", "si", "sur", "un", "une", "vous",
    "al", "como", "con", "cuando", "cuál", "cuánto", "cuántos", "de", "del", "el", "ella", "en", "los", "las", "para", "por", "qué", "se", "su", "una", "y",
)
LITERAL, NUMBER, UNIT, NAME = range(4)
STEPS = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF | 1 for k in range(WINDOW)], np.uint64)
SCHEMA = "id long, text_key long, width int, n_windows int, hash long, pos int, slots array<string>"


def word_hashes(words: tuple) -> np.ndarray:
    data = [np.frombuffer(u.encode(), np.uint8) for u in words]
    return np.sort(np.concatenate([substring_hash(prefix_sums(d), np.array([0]), np.array([len(d)])) for d in data]))


def tokens(data: np.ndarray, offsets: np.ndarray, units: np.ndarray, common: np.ndarray):
    """Starts, ends, kinds, hashes of the tokens, and each text's first token and one past its last.

    A token is a word without the punctuation around it; words of punctuation
    alone, but for %, are skipped. With a digit it is a number; as a listed word a unit;
    with one capital (Latin, Greek or Cyrillic) in front a name, unless it is a common
    word. Where it stands doesn't matter, so a sentence's first word may be a name.
    """
    n = len(data)
    starts, ends, _ = words(data, offsets)
    upper = (data >= 65) & (data <= 90)
    wide = np.zeros(n, bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lower = data + (upper | wide).astype(np.uint8) * np.uint8(32)
    digit = (data >= 48) & (data <= 57)
    letter = digit | upper | ((data >= 97) & (data <= 122)) | (data >= 128) | (data == 37)
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(letter, at, -1))
    if len(starts):
        starts, ends = following[starts], np.minimum(preceding[ends - 1] + 1, ends)
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    first = np.searchsorted(starts, offsets)
    hashes = substring_hash(prefix_sums(lower), starts, ends)
    count = np.concatenate([[0], np.cumsum(digit)])
    kinds = np.zeros(len(starts), np.uint8)
    if len(starts):
        lead, second = data[starts], data[np.minimum(starts + 1, n - 1)]
        point = (lead.astype(int) & 0x1F) << 6 | (second & 0x3F)
        even = ((point >= 0x100) & (point <= 0x137)) | ((point >= 0x14A) & (point <= 0x177))
        odd = ((point >= 0x139) & (point <= 0x148)) | ((point >= 0x179) & (point <= 0x17E))
        other = (even & (point % 2 == 0)) | (odd & (point % 2 == 1)) | ((point >= 0x391) & (point <= 0x3A9)) | ((point >= 0x400) & (point <= 0x42F)) | ((point >= 0xC0) & (point <= 0xDE) & (point != 0xD7))
        big = upper[starts] | ((lead >= 0xC3) & (lead <= 0xDF) & other)
        after = np.where(upper[starts], starts + 1, starts + 2)
        small = (after < ends) & ~upper[np.minimum(after, n - 1)] & ~digit[np.minimum(after, n - 1)]
        listed = lambda known: known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        kinds[big & small & ~listed(common)] = NAME
        kinds[listed(units)] = UNIT
        kinds[count[ends] > count[starts]] = NUMBER
        hashes = np.where(kinds > 0, mix(kinds.astype(np.uint64)), hashes)
    return starts, ends, kinds, hashes, first


def window_rows(data: np.ndarray, offsets: np.ndarray, known: tuple, widths: list[int] | None, bitmap: np.ndarray | None):
    """Of each text the windows with a literal token: text, width, windows of the text, hash, place, slot values.

    Of each of widths, or else of WINDOW tokens or all that a shorter text has.
    """
    starts, ends, kinds, hashes, first = tokens(data, offsets, *known)
    n = np.diff(first)
    out: list[tuple] = []
    for asked in widths or [0]:
        width = np.full(len(n), asked) if asked else np.minimum(n, WINDOW)
        n_windows = np.where((n >= width) & (n > 0), n - width + 1, 0)
        owner = np.repeat(np.arange(len(n)), n_windows)
        if not len(owner):
            continue
        pos = spread(n_windows)
        head, size = first[:-1][owner] + pos, width[owner]
        h = np.zeros(len(owner), np.uint64)
        literal = np.zeros(len(owner), bool)
        for k in range(WINDOW):
            inside = size > k
            t = np.minimum(head + k, len(hashes) - 1)
            h += np.where(inside, hashes[t] * STEPS[k], np.uint64(0))
            literal |= inside & (kinds[t] == LITERAL)
        h = mix(h + size.astype(np.uint64))
        totals = np.bincount(owner[literal], minlength=len(n))
        kept = np.flatnonzero(literal if bitmap is None else literal & in_bitmap(bitmap, h))
        for i in kept.tolist():
            r = range(int(head[i]), int(head[i] + size[i]))
            slots = [data[starts[t] : ends[t]].tobytes().decode("utf-8", "replace").lower() for t in r if kinds[t]]
            out.append((int(owner[i]), int(size[i]), int(totals[owner[i]]), int(h[i].view(np.int64)), int(pos[i]), slots))
    return out


def windows(texts: DataFrame, widths: list[int] | None = None, bitmap=None) -> DataFrame:
    """texts (id, text_key, text) as rows of SCHEMA, one per window and place."""

    def run(batches):
        known = word_hashes(UNITS), word_hashes(COMMON)
        held = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                found = window_rows(data, offsets, known, widths, held)
                owner, width, totals, h, pos, slots = zip(*found) if found else [[]] * 6
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(take), rows.column(1).take(take), pa.array(width, pa.int32()), pa.array(totals, pa.int32()), pa.array(h, pa.int64()), pa.array(pos, pa.int32()), pa.array(slots, pa.list_(pa.string()))],
                    ["id", "text_key", "width", "n_windows", "hash", "pos", "slots"],
                )

    return texts.mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of a document and an item that it has COVERAGE of, with consistent slots.

    Returns doc_id, text_key (xxhash64 of doc_id and text), item_id,
    n_windows (the item's), n_matched, coverage, n_slots, n_conflicts and kind:
    verbatim if every slot keeps the item's value, otherwise reparameterised.
    An item's value conflicts if on one alignment it becomes several values.
    Rows with the same id and text are one document, items with the same id
    and text one item. Null and empty texts have no windows and match nothing; an
    item of fewer than WINDOW tokens has one window of its own width, for which whole
    documents are searched too. Very long texts are read whole. Only the named columns are read.
    """
    c = lambda name: F.col(f"`{name}`")
    plain = lambda df, i: df.select(c(i).cast("long").alias("id"), F.xxhash64(c(i), text_of(c(text))).alias("text_key"), text_of(c(text)).alias("text"))
    asked = stored(windows(plain(items, item_id).distinct()), "items")
    widths = [r.width for r in asked.select("width").distinct().collect()]  # WINDOW at most
    held = windows(plain(docs, doc_id), widths or [WINDOW], bitmap_of(asked.select("hash")))
    item = asked.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "n_windows", "hash", F.col("pos").alias("at"), F.col("slots").alias("asked"))
    met = stored(held.select(F.col("id").alias("doc_id"), "text_key", "hash", "pos", "slots").join(item, "hash"), "met")
    pair = ["doc_id", "text_key", "item_id", "item_key"]
    cover = met.groupBy(*pair, "n_windows").agg(F.count_distinct("at").alias("n_matched")).where(F.col("n_matched") >= COVERAGE * F.col("n_windows"))
    slot = met.where(F.size("slots") > 0).select(*pair, (F.col("pos") - F.col("at")).alias("shift"), F.explode(F.arrays_zip("asked", "slots")).alias("s"))
    slot = slot.groupBy(*pair, "shift", F.col("s.asked").alias("asked")).agg(F.count_distinct("s.slots").alias("n"), F.max(F.col("s.asked") != F.col("s.slots")).alias("other"))
    slot = slot.groupBy(*pair).agg(F.count("*").alias("n_slots"), F.sum((F.col("n") > 1).cast("long")).alias("n_conflicts"), F.max("other").alias("other"))
    same = lambda a, b: a.eqNullSafe(b)
    c, s = cover.alias("c"), slot.alias("s")
    on = None
    for k in pair:
        on = same(F.col(f"c.{k}"), F.col(f"s.{k}")) if on is None else on & same(F.col(f"c.{k}"), F.col(f"s.{k}"))
    out = c.join(s, on, "left").select(
        *[F.col(f"c.{k}") for k in pair[:3]], F.col("n_windows").cast("long").alias("n_windows"), "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"),
        F.when(F.coalesce("other", F.lit(False)), "reparameterised").otherwise("verbatim").alias("kind"),
    )
    return out.where(F.col("n_conflicts") <= MAX_CONFLICTS * F.col("n_slots"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that leak an item; all their columns stay, whatever their names.

    Repeated rows stay or go together; null and empty texts stay. Only the keys
    of rows that leak are shuffled against the rows.
    """
    c = lambda name: F.col(f"`{name}`")
    key = F.xxhash64(c(doc_id), text_of(c(text)))
    plain = docs.select(c(doc_id).alias("doc_id"), c(text).alias("text"))
    other = items.select("item_id", c(text).alias("text"))
    found = leaks(plain, other).select(F.col("text_key").alias("key")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*[c(x) for x in docs.columns]).alias("row"))
    return rows.join(found, "key", "left_anti").select(*[F.col("row")[x].alias(x) for x in docs.columns])
