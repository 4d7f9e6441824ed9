"""Fill-in-middle: a table-driven automaton over bytes counts units and finds sentinels; a second pass locates the cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_chunks

#: What marks prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a text that one lane of the scan takes.
LANE = 64


class Automaton:
    """A deterministic automaton over bytes, for text in UTF-8 and sentinels to recognise.

    A state is how much of a sentinel has been read and how many continuation bytes are due. A transition emits a
    counted unit where a code point begins (a stray continuation byte is a unit of its own) and a sentinel's number where one
    ends. Bytes that every state treats alike share a class; `still` is a class that leaves each state as it is.
    """

    def __init__(self, sentinels: Sequence[bytes]):
        heads = {s[:i] for s in sentinels for i in range(len(s))}

        def step(state: tuple[bytes, int], byte: int) -> tuple[tuple[bytes, int], int, int]:
            read, due = state
            inside = byte & 0xC0 == 0x80
            unit = not (inside and due)
            due = max(0, due - 1) if inside else 1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0
            read += bytes([byte])
            while read not in heads and read not in sentinels:
                read = read[1:]
            if read in sentinels:
                return (b"", due), unit, 1 + sentinels.index(read)
            return (read, due), unit, 0

        states = {(b"", 0): 0}
        rows: list[list[tuple[int, int, int]]] = []
        for state in (todo := list(states)):
            row = []
            for byte in range(256):
                to, unit, hit = step(state, byte)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append((states[to], int(unit), hit))
            rows.append(row)
        whole = np.array(rows, np.int64)
        columns, self.class_of = np.unique(whole.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        self.class_of = self.class_of.reshape(-1).astype(np.int64)
        table = columns.reshape(len(columns), len(rows), 3).transpose(1, 0, 2)
        self.still, self.states, self.classes = len(columns), len(rows), len(columns) + 1
        stay = np.zeros((self.states, 1, 3), np.int64)
        stay[:, 0, 0] = np.arange(self.states)
        table = np.concatenate([table, stay], axis=1)
        self.sentinel = table[..., 2].reshape(-1)
        self.unit = table[..., 1].reshape(-1)
        # Low 16 bits: the next state's row; above them 1 for a unit, and 256 for a sentinel.
        self.table = (table[..., 0] * self.classes + (table[..., 1] << 16) + ((table[..., 2] > 0) << 24)).reshape(-1)


@cache
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton([s.encode() for s in sentinels])


class Scan:
    """The first pass over consecutive texts: each lane of LANE bytes runs from every state at once, counting what its
    transitions emit; lanes are then chained from each text's beginning.

    units, hits: code points and sentinels of each text.
    """

    def __init__(self, auto: Automaton, data: np.ndarray, offsets: np.ndarray):
        self.auto, self.data, self.offsets = auto, data, offsets
        lanes = -(-np.diff(offsets) // LANE)
        self.first = np.cumsum(lanes) - lanes
        self.doc = np.repeat(np.arange(len(lanes)), lanes)
        self.start = offsets[self.doc] + (np.arange(len(self.doc)) - self.first[self.doc]) * LANE
        classes = self._classes(np.arange(len(self.doc)))
        row = np.repeat(np.arange(auto.states)[:, None] * auto.classes, len(self.doc), axis=1)
        emitted = np.zeros_like(row)
        for c in classes:
            row += c
            code = auto.table[row]
            emitted += code >> 16
            row = code & 0xFFFF
        ends, state, opening = (row // auto.classes).tolist(), 0, np.zeros(len(self.doc), bool)
        opening[self.first[lanes > 0]] = True
        self.state = np.empty(len(self.doc), np.int64)
        for i, new in enumerate(opening.tolist()):
            state = 0 if new else state
            self.state[i] = state
            state = ends[state][i]
        emitted = emitted[self.state, np.arange(len(self.doc))]
        self.lane_hits = emitted >> 8
        self.before = np.concatenate([[0], np.cumsum(emitted & 0xFF)])
        total = lambda x: np.bincount(self.doc, x, len(lanes)).astype(np.int64)
        self.units, self.hits = total(emitted & 0xFF), total(self.lane_hits)

    def _classes(self, lanes: np.ndarray) -> np.ndarray:
        """Byte classes of the lanes, a row for each place in a lane; places past a text's end stand still."""
        at = self.start[lanes] + np.arange(LANE)[:, None]
        past = at >= self.offsets[self.doc[lanes] + 1]
        out = self.auto.class_of[self.data[np.where(past, 0, at)]]
        out[past] = self.auto.still
        return out

    def _emissions(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """What each transition of the lanes emits, by table; (LANE, lanes)."""
        row = self.state[lanes] * self.auto.classes
        out = np.empty((LANE, len(lanes)), np.int64)
        for i, c in enumerate(self._classes(lanes)):
            row += c
            out[i] = table[row]
            row = self.auto.table[row] & 0xFFFF
        return out

    def locate(self, docs: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The second pass: byte offsets after the first `units` units of the texts named; units are at most the text's."""
        out = self.offsets[docs + 1].copy()
        inner = np.flatnonzero(units < self.units[docs])
        if len(inner):
            sought = self.before[self.first[docs[inner]]] + units[inner]
            lanes = np.searchsorted(self.before, sought, side="right") - 1
            used, where = np.unique(lanes, return_inverse=True)
            place = np.cumsum(self._emissions(used, self.auto.unit), axis=0)[:, where]
            out[inner] = self.start[lanes] + (place > sought - self.before[lanes]).argmax(axis=0)
        return out

    def sentinels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number from 1, byte offset after it) of every sentinel, in order."""
        lanes = np.flatnonzero(self.lane_hits)
        found = self._emissions(lanes, self.auto.sentinel).T
        lane, place = np.nonzero(found)
        return self.doc[lanes[lane]], found[lane, place], self.start[lanes[lane]] + place + 1


def _strings(texts: list[bytes]) -> pa.Array:
    """Bytes as they are, as a string column."""
    raw = pa.array(texts, pa.binary())
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2] or pa.py_buffer(b""), raw.buffers()[0], raw.null_count)


def fill_in_middle(docs: DataFrame, seed: int = 1, whole_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs.

    n counts code points. The first four 8-digit groups of the SHA-256 of 'seed:doc_id' choose two cuts, and whether a text
    stays plain and which order its parts take: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each
    behind its sentinel. Texts that are empty or hold a sentinel stay plain, with null prefix_chars and middle_chars.

    A null text is empty; a row without doc_id is hashed with an empty id; rows that repeat a doc_id are cut at the same
    draws, each by its own length. Texts are read whole, in time by their bytes; extra columns are ignored; an empty
    table gives no rows.
    """
    doc_id = column(docs, "doc_id", "long")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(draw, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    docs = docs.select(doc_id.cast("long").alias("doc_id"), column(docs, "text", "string").alias("text"), *draws)
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(sentinels)
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                h = [b.column(f"h{x}").slice(i, j - i).to_numpy() for x in (1, 2, 3, 4)]
                scan = Scan(auto, data, offsets)
                n = scan.units
                plain = (n == 0) | (scan.hits > 0) | (h[2] % 100 >= 100 - whole_percent)
                spm = h[3] % 100 < spm_percent
                cut = np.flatnonzero(~plain)
                x, y = h[0][cut] % (n[cut] + 1), h[1][cut] % (n[cut] + 1)
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                raw = data.tobytes()
                out = [raw[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
                first, second = scan.locate(cut, lo), scan.locate(cut, hi)
                for d, a, z in zip(cut.tolist(), (first - offsets[cut]).tolist(), (second - offsets[cut]).tolist()):
                    t = out[d]
                    out[d] = s + t[z:] + p + t[:a] + m + t[a:z] if spm[d] else p + t[:a] + s + t[z:] + m + t[a:z]
                chars = [np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)]
                chars[0][cut], chars[1][cut] = lo, hi - lo
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(form.tolist(), pa.string()), *(pa.array(c, mask=plain) for c in chars), _strings(out)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(cut: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of fill_in_middle and `restored`, the text rebuilt from output and form alone: the automaton finds the three
    sentinels, and the parts go back into their order. A plain output is its text, and a null output is null. An output that
    says psm or spm and hasn't three sentinels is an error."""
    size = [len(x.encode()) for x in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(sentinels)
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("output")):
                part = b.slice(i, j - i)
                doc, number, end = Scan(auto, data, offsets).sentinels()
                at = np.searchsorted(doc, np.arange(j - i + 1))
                raw = data.tobytes()
                out: list[bytes | None] = []
                for d, form in enumerate(part.column("form").to_pylist()):
                    a, z = int(offsets[d]), int(offsets[d + 1])
                    if form == "plain" or not part.column("output").is_valid()[d].as_py():
                        out.append(raw[a:z] if form == "plain" and part.column("output").is_valid()[d].as_py() else None)
                        continue
                    marks = [(int(k), int(e)) for k, e in zip(number[at[d] : at[d + 1]], end[at[d] : at[d + 1]])]
                    if sorted(k for k, _ in marks) != [1, 2, 3]:
                        raise ValueError("an output without its three sentinels")
                    stops = [e - size[k - 1] for k, e in marks[1:]] + [z]
                    pieces = {k: raw[e:stop] for (k, e), stop in zip(marks, stops)}
                    out.append(pieces[1] + pieces[3] + pieces[2])
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(out)], [*part.schema.names, "restored"])

    return cut.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


INFILL_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
parts AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
