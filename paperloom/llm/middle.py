"""Fill-in-the-middle: documents cut at two tokens and told out of order.

Texts are cut into chunks where a rolling hash of the last bytes says so, so a
passage that many documents share gives the same chunks in each. What a chunk
adds to its neighbours (code points, tokens that end inside, whether it begins
and ends with white space) is computed once a task and kept in a cache of
bounded size. The cache is keyed by the chunk's bytes, so a hit is verified by
content. Sums of these summaries give a document's tokens and the one or two
chunks that its cuts lie in; only those are looked at byte by byte. No shuffle.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix
from .common import text_of

SEED = 42
#: Percent of documents that are cut at all, and of those that come suffix first.
RATE, SUFFIX_FIRST = 50, 80
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Bytes that the rolling hash sees, and the least, usual (a power of two) and most bytes of a chunk.
WINDOW, LEAST, USUAL, MOST = 16, 256, 1024, 8192
#: Bytes of chunks that a task's cache holds.
CACHE = 16_000_000


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places where the hash of the WINDOW bytes before is a multiple of USUAL."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)[data]
    width, factor = 1, 0x9E3779B1
    while width < WINDOW:
        h = h[:-width] * np.uint32(factor) + h[width:]
        width, factor = width * 2, factor * factor & 0xFFFFFFFF
    return np.flatnonzero(h >> np.uint32(32 - USUAL.bit_length() + 1) == 0) + WINDOW


def bounds(found: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text at start..end: found places, but none under LEAST bytes and none over MOST."""
    out, last = [], start
    for p in (*found, end):
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p > last and (p - last >= LEAST or p == end):
            last = p
            out.append(p)
    return out


def inner_ends(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a chunk, which of them are white space, and where inside it a token ends."""
    c = np.frombuffer(chunk, np.uint8)
    gap = (c == 32) | ((c >= 9) & (c <= 13))
    return c, gap, np.flatnonzero(gap[1:] & ~gap[:-1]) + 1


def points(c: np.ndarray) -> int:
    """Code points that begin in these bytes."""
    return int(np.count_nonzero((c & 0xC0) != 0x80))


class Summaries:
    """(code points, tokens that end inside, begins with space, ends with space) by the bytes of a chunk."""

    def __init__(self, most: int = CACHE):
        self.most, self.held, self.bytes, self.hits = most, OrderedDict(), 0, 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.held.get(chunk)
        if found is not None:
            self.hits += 1
            self.held.move_to_end(chunk)
            return found
        c, gap, inside = inner_ends(chunk)
        found = self.held[chunk] = (points(c), len(inside), bool(gap[0]), bool(gap[-1]))
        self.bytes += len(chunk)
        while self.bytes > self.most:
            self.bytes -= len(self.held.popitem(last=False)[0])
        return found


def cut(raw: bytes, ends: list[int], kinds: list[tuple], k: int) -> tuple[int, int]:
    """Byte and code point at which the k-th token of a text ends, 0 for none; kinds are the summaries of its chunks."""
    if k == 0:
        return 0, 0
    start = seen = before = 0
    after_space = True
    for end, (n, inside, begins, finishes) in zip(ends, kinds):
        if begins and not after_space:
            seen += 1
            if seen == k:
                return start, before
        if seen + inside >= k:
            c, _, at = inner_ends(raw[start:end])
            at = int(at[k - seen - 1])
            return start + at, before + points(c[:at])
        seen, before, start, after_space = seen + inside, before + n, end, finishes
    return start, before


def rearranged(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, h1, h2, form) with n, prefix_chars, middle_chars, n_chunks and output.

    A chunk of rows is handled at a time, so memory follows its size or that of
    the longest single text.
    """
    p, s, m = (MARKS[x].encode() for x in ("prefix", "suffix", "middle"))

    def run(batches):
        known = Summaries()
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                found = chunk_ends(data)
                edge = np.searchsorted(found, offsets)
                whole = data.tobytes()
                out = []
                for k, (h1, h2, form) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("h1", "h2", "form")))):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    raw = whole[a:b]
                    # A window must not reach back into the text before.
                    ends = [x - a for x in bounds([x for x in found[edge[k] : edge[k + 1]].tolist() if x - a >= WINDOW], a, b)]
                    kinds = [known.of(raw[i:j]) for i, j in zip([0, *ends], ends)]
                    n = sum(x[1] for x in kinds) + sum(y[2] and not x[3] for x, y in zip(kinds, kinds[1:])) + bool(raw)
                    if form == "plain":
                        out.append((n, None, None, len(ends), raw))
                        continue
                    (i, at), (j, to) = (cut(raw, ends, kinds, x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
                    parts = (p, raw[:i], s, raw[j:], m, raw[i:j]) if form == "psm" else (s, raw[j:], p, raw[:i], m, raw[i:j])
                    out.append((n, at, to - at, len(ends), b"".join(parts)))
                cols = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary()).cast(pa.string())]
                names = ["n", "prefix_chars", "middle_chars", "n_chunks", "output"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("form"), *arrays], ["doc_id", "form", *names])

    return texts.mapInArrow(run, "doc_id long, form string, n long, prefix_chars long, middle_chars long, n_chunks long, output string")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, form, n, prefix_chars, middle_chars, n_chunks, output) of each row.

    A token is a word with the white space before it, or the white space at the
    end. Cuts and form depend on seed and doc_id alone, and so repeated rows come
    out alike; a null id counts as the empty string. Texts that are null, empty
    or hold a mark stay plain; very long texts, words and runs of white space
    are cut like others. Other columns aren't read, whatever their names.
    """
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(code, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    body = text_of(F.col(text))
    plain = (body == "") | (h[2] % 100 >= rate)
    for mark in MARKS.values():
        plain |= F.contains(body, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    return rearranged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form")))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output was made of: its marks tell the parts apart, for the text itself holds none."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    rest = F.substr(out, F.lit(1 + len(MARKS["prefix"])))
    psm = F.split(rest, f"{MARKS['suffix']}|{MARKS['middle']}", 3)
    spm = F.split(rest, f"{MARKS['prefix']}|{MARKS['middle']}", 3)
    return F.when(form == "plain", out).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the rows of fill_in_middle."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def draw(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that fill_in_middle draws for an id."""
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
b AS (SELECT *, CAST(len(k) AS BIGINT) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS i, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM a),
c AS (SELECT *, array_to_string(k[1:i], '') AS p, array_to_string(k[i + 1:j], '') AS m, array_to_string(k[j + 1:], '') AS s FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
