"""SentencePiece encoding and decoding by a table of each prefix's last token.

For a merge-type vocabulary the encoding of every prefix of a text ends in exactly one token, and the
encoding of the whole text is found by walking those last tokens backwards. The table is filled from
left to right: an Aho-Corasick automaton gives the pieces that end at each position, and of these the
one that can stand after the last token of the prefix before it is taken. Whether two tokens can stand
side by side depends on these two alone.

Before that the text is cut where no merge can ever reach across (before a run of word marks, and
around characters of which no piece consists); equal parts are encoded once and remembered in a
bounded memory.

Null and empty texts give only the begin and end ids and decode to the empty text. Texts of any
length, repeated rows and ties are handled alike: each row is encoded on its own. An empty table
gives an empty table; columns named like the outputs (ids, decoded) give way to them, others stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, filled, held, texts, with_columns

MARK = "▁"


class PrefixTable:
    """The encoder for one model file. memory: how many parts are remembered before all are forgotten."""

    def __init__(self, model_file: str, memory: int = 400_000):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes_at = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        #: A merge comes the earlier the higher its piece's score.
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.rank = {i: k for k, i in enumerate(order)}
        self.text = {i: p for p, i in self.piece.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.piece.items():
            if len(p) == 1:
                self.halves[i] = None
            else:
                parts, last = self.merged(p)
                if parts != [i]:
                    continue  # no text is ever encoded by it
                self.halves[i] = last
            automaton.add_word(p, (len(p), i))
        automaton.make_automaton()
        self.automaton = automaton
        grows = all(h is None or all(self.halves[x] is None or self.rank[x] < self.rank[i] for x in h) for i, h in self.halves.items())
        self.fits = self.fits_by_spines if grows else self.fits_by_merging
        letters = set("".join(self.piece))
        inner = any(MARK in p.lstrip(MARK) for p in self.piece)
        lone = "\n" if "\n" not in letters else ""
        if inner:
            self.cut = re.compile("(?s).+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else ""))
        self.pairs: dict[int, bool] = {}
        self.known = Memory(lambda s: array("I", self.part(s)).tobytes(), memory)
        self.frame = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()

    def merged(self, s: str) -> tuple[list[int], tuple[int, int] | None]:
        """Encodes s by merging step by step; also gives the last pair merged. Characters that are no piece are -1 - code."""
        parts = [self.piece.get(c, -1 - ord(c)) for c in s]
        last = None
        while True:
            best = None
            for k in range(len(parts) - 1):
                if parts[k] >= 0 and parts[k + 1] >= 0 and (m := self.piece.get(self.text[parts[k]] + self.text[parts[k + 1]])) is not None and (best is None or self.rank[m] < best[0]):
                    best = self.rank[m], k, m
            if best is None:
                return parts, last
            _, k, m = best
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [m]

    def fits_by_merging(self, a: int, b: int) -> bool:
        return self.merged(self.text[a] + self.text[b])[0] == [a, b]

    def fits_by_spines(self, a: int, b: int) -> bool:
        """True if no merge ever joins the two tokens while they are being built.

        The tokens that touch the border are a's rightmost and b's leftmost parts. From the smallest on,
        the side whose next part is merged first grows; a merge over the border that comes before both
        spoils the pair. Of equal merges the left one comes first.
        """
        left, right = [a], [b]
        while h := self.halves[left[-1]]:
            left.append(h[1])
        while h := self.halves[right[-1]]:
            right.append(h[0])
        i, j, end = len(left) - 1, len(right) - 1, len(self.rank)
        while True:
            m = self.piece.get(self.text[left[i]] + self.text[right[j]])
            across = end + 1 if m is None else self.rank[m]
            up_left = self.rank[left[i - 1]] if i else end
            up_right = self.rank[right[j - 1]] if j else end
            if across < up_left and across <= up_right and m is not None:
                return False
            if not i and not j:
                return True
            if i and up_left <= up_right:
                i -= 1
            else:
                j -= 1

    def part(self, s: str) -> list[int]:
        """The ids of one part, by the table of its prefixes' last tokens."""
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)  # the last token's length and id; None where no piece ends
        pairs = self.pairs
        for end, match in self.automaton.iter(s):  # at each end the longest piece first
            if last[end + 1] is None:
                if (at := end + 1 - match[0]) and (before := last[at]) is not None:
                    both = before[1] << 32 | match[1]
                    if (ok := pairs.get(both)) is None:
                        ok = pairs[both] = self.fits(before[1], match[1])
                    if not ok:
                        continue
                last[end + 1] = match
        out: list[int] = []
        at = len(s)
        while at:
            if (match := last[at]) is not None:
                out.append(match[1])
                at -= match[0]
                continue
            at -= 1
            if self.bytes_at:
                out.extend(self.bytes_at[f"<0x{x:02X}>"] for x in reversed(s[at].encode()))
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """All ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        parts = self.cut.findall(MARK + text.replace(" ", MARK)) if text else []
        return b"".join([self.frame[0], *map(self.known.__getitem__, parts), self.frame[1]])

    def decode(self, packed: list[bytes]) -> list[str]:
        """The texts of packed ids, a few at a time, as lists of numbers take much room."""
        out: list[str] = []
        for k in range(0, len(packed), 50):
            out += self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in packed[k : k + 50]], num_threads=1)
        return out


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", memory: int = 400_000) -> DataFrame:
    """docs with the packed ids (binary) of each text and, unless None, the text decoded from them."""

    def make():
        table = held(key, lambda: PrefixTable(model_file, memory))

        def batch(b):
            packed = [table.packed(x) for x in texts(b, text)]
            return {ids: packed} | ({decoded: table.decode(packed)} if decoded else {})

        return batch

    key = ("prefix table", model_file, memory)
    return with_columns(docs, f"`{ids}` binary" + f", `{decoded}` string" * bool(decoded), make, holds=key)


def digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", memory: int = 400_000) -> DataFrame:
    """Per document its id, number of ids and the SHA-256 of ids and decoded text; ids and texts stay in the worker."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def make():
        table = held(key, lambda: PrefixTable(model_file, memory))

        def batch(b):
            packed = [table.packed(x) for x in texts(b)]
            return {"n_tokens": [len(x) // 4 for x in packed], "ids_sha256": [sha(x) for x in packed], "decoded_sha256": [sha(x.encode()) for x in table.decode(packed)]}

        return batch

    key = ("prefix table", model_file, memory)
    rows = docs.select(F.col(doc_id).alias("doc_id"), filled().alias("text"))
    return with_columns(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep=["doc_id"], holds=key)
