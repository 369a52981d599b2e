"""Token ids of whole texts for a BPE vocabulary with word ends, by the distinct words of a batch.

The vocabulary drops white space and no token crosses it, so a text's ids are those of its words.  Words of plain
characters (no composition, one lower-case form) are cut by the tokenizer's own pattern in Arrow and encoded in one
call of tiktoken, with a line feed as the end of a word; all others, and all words under a tokenizer of another form,
go to the tokenizers library.  Both give the library's ids.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc

from ._common import Memo

#: The tokenizer's pattern, the order of its byte symbols, its mark for the end of a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
VISIBLE = ((33, 127), (161, 173), (174, 256))
END = "</w>"
#: Characters whose lower case is one character, that NFC leaves alone next to each other, and that every version of
#: Unicode puts into the same class: ASCII, Latin letters but for U+0130, Cyrillic, dashes and quotes, kana, Han, Hangul.
PLAIN = "^[!-~\u00a1-\u012f\u0131-\u024f\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*$"


def _sound(left: int, right: int, limit: int, pairs: dict, halves: dict) -> bool:
    """No merge before `limit` crosses the border of two adjacent tokens while they form."""
    while True:
        if pairs.get((left, right), limit) < limit:
            return False
        if left > right:
            limit, left = left, halves[left][1] if left in halves else -1
            if left < 0:
                left, limit = limit, right + 1
                if right not in halves:
                    return True
                right = halves[right][0]
        else:
            limit, right = right + 1, halves[right][0] if right in halves else -1
            if right < 0:
                right, limit = limit - 1, left
                if left not in halves:
                    return True
                left = halves[left][1]


def word_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token, a line feed for the end of a word, with its id; None where the ids would not be the same.

    tiktoken merges any two neighbours whose bytes are a token, by id; the vocabulary merges listed pairs, by rank.
    These agree if ids follow ranks and each listed pair stands when its turn comes (then its bytes come about in no
    other way).
    """
    model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"] if (spec.get("pre_tokenizer") or {}).get("type") == "Sequence" else []
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or normal != ["NFC", "Replace", "Lowercase"]:
        return None
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": PATTERN} or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    ids, shown = model["vocab"], [b for a, z in VISIBLE for b in range(a, z)]
    symbols = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    raw = {ids[s]: bytes([b]) for s, b in symbols.items()} | {ids[s + END]: bytes([b]) + b"\n" for s, b in symbols.items()}
    first, pairs, halves, last = max(raw), {}, {}, max(raw)
    for a, b in (x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
        token, x, y = ids[a + b], ids[a], ids[b]
        if token != last + 1 or not _sound(x, y, token, pairs, halves):
            return None
        raw[token], pairs[x, y], halves[token], last = raw[x] + raw[y], token, (x, y), token
    if len(set(raw.values())) != len(raw) or first != 511:
        return None
    return {b: i for i, b in raw.items() if b"\n" not in b[:-1]}


class WordBpe:
    """Encoder of a worker.  `words` takes distinct words without ASCII white space."""

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.memo, self.library, self.fast = path, Memo(limit), None, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        if ranks := word_ranks(spec):
            import tiktoken

            self.gap = ranks[b"\n"]  # the id of a line feed, which no word holds
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, words: list[bytes], width: str) -> list[bytes]:
        from array import array

        if self.library is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        self.memo.room(len(words))
        new = [w for w in words if not self.memo.known(w)]
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            found = self.library.encode_batch_fast(list(map(bytes.decode, part)), add_special_tokens=False)
            self.memo.update((w, array(width, e.ids).tobytes()) for w, e in zip(part, found))
        return [self.memo[w] for w in words]

    def _plain(self, words: pa.Array, kind: str) -> pa.Array:
        import numpy as np

        # each piece of the pattern ends in a line feed, and each word in one more
        cut = pc.replace_substring_regex(pc.utf8_lower(words), PATTERN, "\\0\n")
        cut = pc.binary_join_element_wise(cut, pa.scalar("\n", cut.type), pa.scalar("", cut.type))
        raw = cut.buffers()[2]
        ids = self.fast.encode_to_numpy(raw.to_pybytes().decode() if raw else "", allowed_special=set(), disallowed_special=())
        gaps = np.flatnonzero(ids == self.gap)
        size = np.dtype(kind).itemsize
        ends = np.r_[0, gaps - np.arange(len(gaps))].astype(np.int64) * size
        data = ids[ids != self.gap].astype(kind).tobytes()
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def words(self, words: pa.Array, kind: str) -> pa.Array:
        """Packed ids of each word."""
        import numpy as np

        if self.fast is None:
            plain = np.zeros(len(words), bool)
        else:
            plain = pc.match_substring_regex(words, PLAIN)
            for token in self.special:
                plain = pc.and_not(plain, pc.match_substring(words, token))
            plain = plain.to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(words, kind)
        others = words.filter(pa.array(~plain)).cast(pa.large_binary()).to_pylist()
        out = pa.array(self._by_library(others, "H" if kind == "<u2" else "I"), pa.large_binary())
        if not plain.any():
            return out
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(plain.sum()), plain.sum() + np.arange(len(others))
        return pa.concat_arrays([self._plain(words.filter(pa.array(plain)), kind), out]).take(pa.array(place))


_encoders: dict[str, WordBpe] = {}


def tokenized(path: str, text: pa.Array, kind: str) -> list[bytes]:
    """Packed ids of texts; a null text has none."""
    import numpy as np

    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    if not len(coded):
        return [b""] * len(text)
    joined = _encoders[path].words(coded.dictionary, kind).take(coded.indices)
    places = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = memoryview(joined.buffers()[2])
    cuts = places[ends - ends[0]].tolist()
    return [bytes(raw[i:j]) for i, j in zip(cuts, cuts[1:])]
