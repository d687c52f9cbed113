"""Splitting texts at sure token borders, so that tokenizers run once per distinct piece."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before one of these characters, none of which is white space: every
#: token of the byte-level patterns that holds such a space begins with it, and the
#: patterns look at nothing before a token, so a text can be cut there. A text with
#: another kind of space is not cut at all.
_ODD = " (?:[^!-~À-ɏ]|$)"
#: Letters and what follows them: the patterns end a token where letters end, and
#: the rest begins with an ASCII character that is none.
_STEM = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<rest>|[\x00-@\[-`{-\x7f][\s\S]*)$"


@dataclass(frozen=True)
class Pieces:
    """Texts as runs of pieces. ``first`` is what stands before a text's first cut (the
    whole text where it is not cut); ``pieces`` are the distinct pieces after a cut, each
    to be read after a space; those of text i are code[begin[i] : begin[i + 1]]."""

    first: list[str]
    pieces: pa.StringArray
    code: np.ndarray
    begin: np.ndarray

    def stems(self) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """(distinct stems, distinct rests, stem and rest of each piece): a piece is a stem
        of Latin letters after a space, and a rest; -1 for the stem and for the rest of a
        piece that does not split so."""
        found = pc.extract_regex(self.pieces, _STEM)
        stem, rest = (found.field(k).dictionary_encode() for k in (0, 1))
        split = found.is_valid().to_numpy(zero_copy_only=False)
        at = [np.where(split, pc.fill_null(x.indices, -1).to_numpy(), -1) for x in (stem, rest)]
        return [x or "" for x in stem.dictionary.to_pylist()], [x or "" for x in rest.dictionary.to_pylist()], *at


def pieces(said: pa.StringArray) -> Pieces:
    """The pieces of texts (null: empty)."""
    said = pc.fill_null(said, "")
    odd = pc.match_substring_regex(said, _ODD)
    whole = pc.if_else(odd, said, "")
    cut = pc.split_pattern(pc.if_else(odd, "", said), " ")
    code = cut.flatten().dictionary_encode()
    begin = cut.offsets.to_numpy().astype(np.int64)
    begin -= begin[0]
    at = code.indices.to_numpy()
    first = pc.binary_join_element_wise(whole, code.dictionary.take(pa.array(at[begin[:-1]])), "").to_pylist()
    rest = np.ones(len(at), dtype=bool)
    rest[begin[:-1]] = False
    used, at = np.unique(at[rest], return_inverse=True)
    return Pieces(first, code.dictionary.take(pa.array(used)), at.astype(np.int32), begin - np.arange(len(begin)))


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The runs pool[begin[k] : begin[k] + size[k]] of each k in ``of``, one after another."""
    n = size[of]
    at = np.repeat(begin[of] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return pool[at]


def assemble(said: pa.StringArray, spell: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]], closing: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, ``closing`` after each, one after another, and their numbers.

    spell(stems, strings) gives the ids, one after another, and their numbers: of each
    stem after a space, then of each string by itself."""
    found = pieces(said)
    stems, rests, stem, rest = found.stems()
    other = np.flatnonzero(stem < 0)
    n, count = len(found.first), np.diff(found.begin)
    ids, size = spell(stems, [*rests, *(" " + s for s in found.pieces.take(pa.array(other)).to_pylist()), *found.first])
    ids, size = np.append(ids, np.array([*closing], dtype=ids.dtype)), np.append(size, [0, len(closing)])
    begin = np.cumsum(size) - size
    # a piece: its stem and its rest, or all of it and nothing
    pair = np.empty((len(stem), 2), dtype=np.int64)
    pair[:, 0], pair[:, 1] = stem, len(stems) + rest
    pair[other, 0], pair[other, 1] = len(stems) + len(rests) + np.arange(len(other)), len(size) - 2
    word, word_size = gather(ids, begin, size, pair.ravel()), size[pair].sum(axis=1)
    # a text: its first piece, the others, the closing ids
    at = np.full(int(count.sum()) + 2 * n, -1, dtype=np.int64)
    head = found.begin[:-1] + 2 * np.arange(n)
    at[head] = len(word_size) + len(size) - 2 - n + np.arange(n)
    at[head + count + 1] = len(word_size) + len(size) - 1
    at[at < 0] = found.code
    begin, size = np.concatenate([np.cumsum(word_size) - word_size, begin + len(word)]), np.concatenate([word_size, size])
    return gather(np.concatenate([word, ids]), begin, size, at), np.add.reduceat(size[at], head) if n else np.zeros(0, dtype=np.int64)
