r"""Fill-in-middle: cut a text at two of its lines and put the middle last, by an indexable skip list over its lines.

A text's units are its lines with their ends (`[^\n]*\n|[^\n]+`). The skip list has a ground lane with a node for each
unit and express lanes above it, each with every FAN-th node of the lane below; a node carries how many units and how
many code points lie before the next one of its lane. From the head of the highest lane, a search goes on while the
units walked and the next width stay within the rank, then goes down a lane: both cut ranks are met exactly, in
O(FAN * log n) steps, with the code points before them at hand. Towers have fixed heights (how often FAN divides a
node's number), as a text does not change once its list is built.

Which lines: the first four groups of 8 hex digits of sha256("<seed>:<doc_id>") are h1 to h4. With n units the prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if it is
empty, holds a mark, or h3 % 100 >= rate; otherwise the suffix comes first (spm) if h4 % 100 < spm, else the prefix (psm).

Null texts are empty, hence plain; a null doc_id counts as no digits. A text without a line end is one unit, one of any
length is cut in its own task, whole. Repeated rows give equal rows; columns other than doc_id and text are left out,
whatever their names. An empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
FAN = 4
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


class SkipList:
    """lanes[k]: (units, code points) from each of its nodes to the next; node i of a lane stands over node FAN * i of the lane below."""

    def __init__(self, points: np.ndarray):
        """points: code points of each unit."""
        lane = (np.ones(len(points), np.int64), np.asarray(points, np.int64))
        self.lanes = [lane]
        while len(lane[0]) > FAN:
            heads = np.arange(0, len(lane[0]), FAN)
            lane = tuple(np.add.reduceat(width, heads) for width in lane)
            self.lanes.append(lane)

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them if it is the number of units."""
        node = units = points = 0
        for widths, spans in reversed(self.lanes):
            node *= FAN
            while node < len(widths) and units + widths[node] <= rank:
                units, points, node = units + int(widths[node]), points + int(spans[node]), node + 1
        if units != rank:
            raise IndexError(f"rank {rank} of {units} units")
        return points


def lines(text: str) -> list[int]:
    """Code points of each line with its end."""
    parts = text.split("\n")
    sizes = [len(x) + 1 for x in parts]
    sizes[-1] -= 1
    return sizes if sizes[-1] else sizes[:-1]


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: str, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output of one text."""
    units = lines(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return len(units), PLAIN, None, None, text
    index = SkipList(np.array(units))
    a, z = (index.seek(rank) for rank in sorted((h1 % (len(units) + 1), h2 % (len(units) + 1))))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < spm:
        return len(units), SPM, a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(units), PSM, a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text again. No mark can begin in a part and end in a mark, so the first of each is the one put there."""
    if form == PLAIN:
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return f"{two}{middle}{one}" if form == SPM else f"{one}{middle}{two}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, with_text: bool = True) -> DataFrame:
    """RESULT of every row of docs(doc_id, text); output is null unless with_text."""
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    schema = pa.schema(kinds)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                n, form, before, middle, output = rearranged(doc_id, text or "", seed, rate, spm)
                rows.append((doc_id, n, form, before, middle, output if with_text else None, sha(output), sha(restored(output, form))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, RESULT)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:n], '') AS s FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
