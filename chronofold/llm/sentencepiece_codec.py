"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

A byte-pair encoding is fixed by its adjacent pairs: tokens p, t may stand side by side exactly when merging p+t gives
[p, t] back.  So every prefix of a text has one possible last token.  The table stores it: for each place an automaton
lists the pieces that end there, and the one whose start holds a compatible last token is entered.  Ids are then read
off backwards.  No piece of the vocabulary has a space mark behind another character, so a text falls into chunks that
no token crosses; each distinct chunk is encoded once for each worker and kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Memo, texts

MARK = "▁"


class PrefixTable:
    """Encoder for a sentencepiece BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, model_file: str, memo: int = 250_000):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark behind another character; chunks would not be independent")
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.single = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        breaks = "".join(re.escape(c) for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.chunks = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" + (f"|[{breaks}]+" if breaks else ""))
        self.memo, self.pairs = Memo(memo), {}
        joined = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        self.loose = "".join(c for c in ".,;:!?" if not any(b == c and a.isalnum() for a, b in joined))

    def merged(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, p: str, t: str) -> bool:
        """May t follow p?  With an empty p: does t encode as itself?"""
        got = self.pairs.get((p, t))
        if got is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            got = self.pairs[p, t] = self.merged(p + t) == ([p, t] if p else [t])
        return got

    def _known(self, s: str) -> list[int]:
        """Ids of a string whose every character is a piece."""
        last: list[str | None] = [None] * (len(s) + 1)
        last[0] = ""
        known, test = self.pairs.get, self.compatible
        for end, piece in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                before = last[end - len(piece)]
                if before is not None:
                    fits = known((before, piece))
                    if test(before, piece) if fits is None else fits:
                        last[end] = piece
        out, i, ids = [], len(s), self.ids
        while i:
            piece = last[i]
            out.append(ids[piece])
            i -= len(piece)
        return out[::-1]

    def chunk(self, s: str) -> tuple[int, ...]:
        out: list[int] = []
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] in self.single:
                j += 1
            if j > i:
                out += self._known(s[i:j])
            if j < len(s):
                out += [self.bytes[b] for b in s[j].encode()]
                j += 1
            i = j
        return tuple(out)

    def _one(self, c: str) -> tuple[int, ...]:
        memo = self.memo
        if memo.known(c):
            return memo[c]
        ids = self.chunk(c)
        if len(c) < 100:
            memo[c] = ids
        return ids

    def _split(self, c: str) -> tuple[int, ...]:
        """Ids of a chunk; marks at its end that no piece joins to what stands before are encoded apart."""
        core = c.rstrip(self.loose)
        if not core or core == c or not core[-1].isalnum():
            return self._one(c)
        return self._one(core) + self._one(c[len(core) :])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts, memo = self.chunks.findall(MARK + text.replace(" ", MARK)), self.memo
        found = list(map(memo.get, parts))
        if None in found:
            memo.room(len(parts))
            for i, v in enumerate(found):
                if v is None:
                    found[i] = self._split(parts[i])
        return list(chain.from_iterable(found))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


_tables: dict[str, PrefixTable] = {}


def table(model_file: str) -> PrefixTable:
    """One for each worker process and model."""
    if model_file not in _tables:
        _tables[model_file] = PrefixTable(model_file)
    return _tables[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, batch: int = 400) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), and with `decoded` also text: what decoding the ids gives.

    A null text counts as empty, which has no ids and decodes to an empty text.  Null ids and repeated rows pass
    through; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                ids = [t.encode(x or "") for x in b["text"].to_pylist()]
                cols = [b["doc_id"], pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    cols.append(pa.array(t.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"][: len(cols)])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)
