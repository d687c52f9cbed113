"""Licence scan: Aho-Corasick over whole texts, licence expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from decisionlake.llm.common import small, table, texts

#: Phrases and their labels (fixed values): the base set.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More notice phrases and tags (fixed values): the method's own.
MORE = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "all rights reserved": "all-rights-reserved",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "licensed under the apache license": "apache-2",
}
#: What a licence allows, 0 nothing to 1 anything (fixed values); others get OTHER.
GRANT = {
    "mit": 1.0, "apache-2": 0.95, "apache-1": 0.9, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0,
    "python": 0.95, "artistic": 0.8, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2,
    "all-rights-reserved": 0.0,
}
OTHER = 0.5
#: Tags before a licence expression, and the ids that are known with their families,
#: each at the begin of an id, longest first (fixed values).
TAGS = ("spdx-license-identifier:", "license-expression:")
FAMILIES = {
    "all-rights-reserved": "all-rights-reserved", "public-domain": "public-domain", "apache-2": "apache-2", "apache-1": "apache-1", "artistic": "artistic",
    "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0", "unlicense": "unlicense", "python": "python", "psf": "python",
    "apache": "apache-2", "0bsd": "bsd", "bsd": "bsd", "bsl": "bsl", "zlib": "zlib", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mpl": "mpl", "epl": "epl",
    "mit": "mit", "x11": "mit", "isc": "isc",
}
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LINE = re.compile(r"[^\r\n]*")
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_KNOWN = re.compile(f"({'|'.join(map(re.escape, FAMILIES))})(?![a-z])")
#: Ids of licences that are not known: references of one's own, or a name with a number.
_SHAPED = re.compile(r"(licenseref|documentref)-|[a-z][a-z0-9.]*-[a-z0-9.+-]*[0-9]")
_RANK = {"or": 1, "/": 1, "and": 2, "with": 3}


def family(name: str) -> str | None:
    """The family of a known licence id (mit, apache-2, gpl, ...), else null."""
    found = _KNOWN.match(name.lower())
    return FAMILIES[found[1]] if found else None


def operand(token: str, after: str | None, joined: bool) -> bool:
    """Whether a token can be a licence, or after ``with`` an exception. Beside an operator
    (``joined``) any token is one, whether it is known or not; by itself a known one, or one
    that is shaped like an id."""
    low = token.lower()
    if after == "with":
        return "-" in low
    return joined or family(low) is not None or _SHAPED.match(low) is not None


def postfix(expression: str) -> list[str]:
    """Shunting-yard: a licence expression in postfix order; ``with`` binds closest,
    then ``and``, then ``or``, which a slash also says. Reading stops at the first token
    that cannot follow (prose after the expression has no operator before it); an operator
    without its right side is dropped, and brackets that are left open close at the end."""
    out: list[str] = []
    ops: list[str] = []
    whole = False  # whether what is read so far ends in an operand
    tokens = _TOKEN.findall(expression)
    # whether the next token after each that closes no bracket is an operator
    follows, nxt = [False] * len(tokens), False
    for i in range(len(tokens) - 1, -1, -1):
        follows[i] = nxt
        if tokens[i] != ")":
            nxt = tokens[i].lower() in _RANK
    for token, before_operator in zip(tokens, follows):
        low = token.lower()
        if token == "(":
            if whole:
                break
            ops.append(token)
        elif token == ")":
            if not whole:
                break
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if ops:
                ops.pop()
        elif low in _RANK:
            if not whole:
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append("or" if low == "/" else low)
            whole = False
        else:
            after = ops[-1] if ops else None
            if whole or not operand(token, after, before_operator or after in _RANK):
                break
            out.append(token)
            whole = True
    while ops and not whole:
        whole = ops.pop() != "("
    out += [op for op in reversed(ops) if op != "("]
    return out


def evaluate(post: list[str]) -> tuple[float, set[str]] | None:
    """(grant, labels): ``and`` takes the stricter side, ``or`` the freer one, an
    exception after ``with`` loosens its licence by a tenth. Licences that are not known
    give no label. None if there is no licence."""
    stack: list[tuple[float, set[str]]] = []
    for token in post:
        if token in _RANK:
            (y, b), (x, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, x + 0.1), a))
                continue
            if len(a) < len(b):
                a, b = b, a
            a |= b  # the larger takes the smaller in, so that long lists stay cheap
            stack.append((min(x, y) if token == "and" else max(x, y), a))
        else:
            name = family(token)
            stack.append((GRANT[name], {name}) if name else (OTHER, set()))
    return stack[-1] if stack else None


def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases, over words with single spaces; of tags, over lower-cased texts."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE}.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str, automata: tuple[ahocorasick.Automaton, ahocorasick.Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score of a text."""
    phrases, tags = automata
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(_TABLE).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    grants: list[float] = []
    for end, (back, label, is_base) in phrases.iter(line):
        labels.add(label)
        grants.append(GRANT[label])
        if is_base:
            base.add(label)
            places.append(end - back)
    said = data.translate(_LOWER).decode("latin-1")
    found = [(end + 1 - size, end + 1) for end, size in tags.iter(said)]
    for (_, at), (upto, _) in zip(found, [*found[1:], (len(said), 0)]):  # to the end of the line or the next tag
        if got := evaluate(postfix(_LINE.match(said, at, upto)[0])):
            grants.append(got[0])
            labels |= got[1]
    first = line.count(" ", 0, min(places)) if places else None
    last = line.count(" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(grants, default=0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Scan (doc_id, text) row by row, without a shuffle.

    Words are runs of digits, letters and non-ASCII characters after A-Z are lowered.
    n_base counts all places of base phrases, overlapping ones too. labels also holds
    the method's own phrases and the known ids in licence expressions after a tag, both
    found by Aho-Corasick (other ids take part in an expression without a label); an expression ends with its line or before the next tag; score is the strictest
    grant among what was found (0 where nothing was). Null texts are empty: no words,
    null places, empty labels. Repeated rows each give a row; an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata()
        for batch in small(batches):
            cols = list(zip(*(scan(t, automata) for t in texts(batch)))) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
