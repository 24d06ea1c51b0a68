"""Fill-in-middle: texts are cut twice at unit borders and put together in another order.

Cuts are found on a wavelet matrix over character classes.  Every UTF-8 byte of a text has a class;
one bit vector per bit of the class code, each stably sorted by the bits before it, answers how many
bytes of a class stand before any place in one step per bit.  Ranks of the classes that begin a unit
add up to the number of units begun before a place, and bisection on that sum finds the place where
a wanted number of units ends.  All cuts of a slice of texts are looked up together, so the index of
about 1 MB of text (or one text, if that is longer) is what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes of bytes: what a character is, and for letters whether it begins a run of them.
BREAK, SPACE, SIGN, WIDE, LETTER, INNER, REST = range(7)
BITS = 3
#: The classes whose bytes begin a unit.  A token is a run of letters A-Z, a-z or one other character.
UNITS = {"token": (BREAK, SPACE, SIGN, WIDE, LETTER), "char": (BREAK, SPACE, SIGN, WIDE, LETTER, INNER)}

BYTE_CLASS = np.full(256, SIGN, np.uint8)
BYTE_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
BYTE_CLASS[0x0A] = BREAK
BYTE_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
BYTE_CLASS[0x80:0xC0] = REST  # the further bytes of a character beyond ASCII
BYTE_CLASS[0xC0:] = WIDE


def classes(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The class of every byte; ``heads`` are the places where a text begins."""
    code = BYTE_CLASS[raw]
    inner = code == LETTER
    inner[1:] &= code[:-1] == LETTER
    inner[:1] = False
    inner[heads[heads < len(raw)]] = False
    code[inner] = INNER
    return code


class WaveletMatrix:
    """Ranks of small codes: how often a code stands before a place."""

    def __init__(self, codes: np.ndarray, bits: int = BITS):
        self.size, self.bits = len(codes), bits
        self.words, self.ones, self.zeros = [], [], []
        for b in reversed(range(bits)):
            bit = (codes >> np.uint8(b)) & np.uint8(1)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            part = np.packbits(bit, bitorder="little")
            packed[: len(part)] = part
            words = packed.view(np.uint64)
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            high = bit.astype(bool)
            self.zeros.append(self.size - int(np.count_nonzero(high)))
            codes = np.concatenate([codes[~high], codes[high]])

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, code: int, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``code`` before each place."""
        ends = np.concatenate([[0], place]).astype(np.int64)
        for level in range(self.bits):
            one = self._ones(level, ends)
            ends = self.zeros[level] + one if code >> (self.bits - 1 - level) & 1 else ends - one
        return ends[1:] - ends[0]

    def count(self, codes: Sequence[int], place: np.ndarray) -> np.ndarray:
        """Occurrences of any of ``codes`` before each place."""
        return sum(self.rank(c, place) for c in codes)


def cut_places(index: WaveletMatrix, begin: np.ndarray, end: np.ndarray, units: np.ndarray, codes: Sequence[int]) -> np.ndarray:
    """Where ``units`` units of the text from ``begin`` to ``end`` have ended: the next unit's first byte, or ``end``."""
    before = index.count(codes, begin)
    lo, hi = begin.copy(), end.copy()  # the first place at which more units have begun
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        more = index.count(codes, np.minimum(mid + 1, end)) - before > units
        hi = np.where(open_ & more, mid, hi)
        lo = np.where(open_ & ~more, mid + 1, lo)
    return lo


def _arranged(kept: int, codes: Sequence[int]):
    """Batches end with text, plain, spm and the two numbers that choose the cuts."""
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, plain, spm, h1, h2 = batch.columns[kept:]
            raw, at = text_bytes(texts)
            plain, spm = plain.to_numpy(zero_copy_only=False), spm.to_numpy(zero_copy_only=False)
            h1, h2 = h1.to_numpy(), h2.to_numpy()
            for lo, hi in slices(at):
                own = raw[at[lo] : at[hi]]
                begin, end = at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo]
                index = WaveletMatrix(classes(own, begin))
                n = index.count(codes, end) - index.count(codes, begin)
                a, b = h1[lo:hi] % (n + 1), h2[lo:hi] % (n + 1)
                one = cut_places(index, begin, end, np.minimum(a, b), codes)
                two = cut_places(index, begin, end, np.maximum(a, b), codes)
                chars = [index.count(UNITS["char"], x) for x in (begin, one, two)]
                whole = plain[lo:hi]
                out = []
                for i, is_plain in enumerate(whole):
                    s, x, y, e = begin[i], one[i], two[i], end[i]
                    if is_plain:
                        out.append(own[s:e].tobytes())
                        continue
                    pre, mid, suf = own[s:x].tobytes(), own[x:y].tobytes(), own[y:e].tobytes()
                    parts = (signs[1], suf, signs[0], pre) if spm[lo + i] else (signs[0], pre, signs[1], suf)
                    out.append(b"".join((*parts, signs[2], mid)))
                form = np.where(whole, "plain", np.where(spm[lo:hi], "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(lo, hi - lo) for k in range(kept)], pa.array(n), pa.array(form.tolist(), pa.string()),
                     pa.array(chars[1] - chars[0], mask=whole), pa.array(chars[2] - chars[1], mask=whole),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names[:kept], "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def draws(id_col: str, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id; a null id draws like the text ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, seed: str = "1",
                   units: str = "token", share: int = 90, spm_share: int = 20) -> DataFrame:
    """One row per input row: the ``keep`` columns (the id), ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``share`` percent of the texts are cut into prefix, middle and suffix; ``spm_share`` percent of
    those have the suffix first.  Cuts lie between units (``token`` or ``char``) and follow from seed
    and id alone, so reruns agree and rows that share an id draw the same numbers.  A null text
    counts as empty.  Empty texts and texts that hold one of the three marks stay plain: the output
    is the text, and both lengths (code points) are null.  Prefix, middle or suffix may be empty.
    Other columns are ignored; a kept column called like a result is an error; an empty table gives
    an empty result.
    """
    keep = [id_col] if keep is None else list(keep)
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    if clash := [c for c in keep if c.lower() in made]:
        raise ValueError(f"{clash} are names of results")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(id_col, seed)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= share)
    rows = docs.select(*[F.col(c) for c in keep], text.alias("__text"), plain.alias("__plain"), (h4 % 100 < spm_share).alias("__spm"),
                       h1.alias("__h1"), h2.alias("__h2"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(_arranged(len(keep), UNITS[units]),
                           f"{kept}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an ``output`` of the given ``form`` was made from.

    A cut text holds no mark and no mark overlaps itself, so the marks found are those put there.
    """
    body = F.substring(output, 4, 2147483647)

    def parts(sign: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, sign, 1)
        rest = F.substring(body, F.char_length(first) + 4, F.lit(2147483647))
        return first, F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(SUFFIX)
    late, early, between = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(output)
