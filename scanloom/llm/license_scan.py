"""Licence scan: an Aho-Corasick pass finds identifier tags and notice phrases,
a shunting-yard parser evaluates the expressions behind the tags.

Base labels come from fixed word phrases.  The method adds labels from more
phrases and from expressions such as ``(MIT OR GPL-2.0-only WITH x) AND BSD-3-Clause``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm.common import alnum_words, slices

#: The base phrases, word by word, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases (words as in ``alnum_words``) and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Tags in front of a licence expression, in lower-cased raw text.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Tags that also stand in prose; behind them only expressions with a licence of a known family count.
LOOSE_TAGS = ("license:", "licence:")

#: How freely text under a licence family may be used for training; longest matching beginning counts.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nd": 0.2, "cc-by-nc": 0.1,
    "mpl": 0.7, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.4
EXCEPTION_GAIN = 0.2
_TOKEN = re.compile(r"[ \t\r\f\v]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_FORMED = re.compile(r"[0-9-]|^licenseref")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=4096)
def freedom(identifier: str) -> float:
    """Degree of one identifier: that of its longest known beginning."""
    known = [k for k in FREEDOM if identifier == k or identifier.startswith((k + "-", k + "."))]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


@dataclass
class Expression:
    """A parsed licence expression: its identifiers and its degree from 0 to 1."""

    names: list[str] = field(default_factory=list)
    degree: float = UNKNOWN
    valid: bool = False


def _apply(operator: str, values: list[float]) -> bool:
    if len(values) < 2:
        return False
    right, left = values.pop(), values.pop()
    if operator == "and":  # all terms bind
        values.append(min(left, right))
    elif operator == "or":  # the user may choose
        values.append(max(left, right))
    else:  # an exception loosens its licence
        values.append(min(1.0, left + EXCEPTION_GAIN))
    return True


def evaluate(text: str, start: int = 0, stop: int | None = None, loose: bool = False) -> Expression:
    """Shunting-yard over ``or`` < ``and`` < ``with`` and brackets.

    Reads the longest well-formed beginning of ``text[start:stop]``: it stops
    where an operand would follow an operand, at an unmatched bracket, at the
    full stop behind a word, at any other sign, or at its end.  In prose
    (``loose``) an operand behind an operator must look like an identifier: of a
    known family, or with a digit or hyphen.  Tokens are read one by one, so what
    follows costs nothing.  An expression without an operand is not valid.
    """
    out, operators, names, operand_next, after_with = [], [], [], True, False
    stop, ended = len(text) if stop is None else stop, False
    while not ended and (match := _TOKEN.match(text, start, stop)):
        token, start = match.group(1), match.end()
        low = token.lower().rstrip(".")
        ended = token.endswith(".")
        if low in _PRECEDENCE:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[low]:
                _apply(operators.pop(), out)
            operators.append(low)
            operand_next, after_with = True, low == "with"
        elif token == "(":
            if not operand_next or after_with:
                break
            operators.append("(")
        elif token == ")":
            if operand_next or "(" not in operators:
                break
            while operators[-1] != "(":
                _apply(operators.pop(), out)
            operators.pop()
        else:
            if not operand_next or (loose and operators and operators[-1] != "(" and freedom(low) == UNKNOWN and not _FORMED.search(low)):
                break
            if after_with:
                out.append(0.0)  # the exception itself; only its presence counts
            else:
                names.append(low)
                out.append(freedom(low))
            operand_next, after_with = False, False
    if operand_next and operators and operators[-1] != "(":
        operators.pop()  # an operator that waits for its right side
    while operators:
        operator = operators.pop()
        if operator != "(":
            _apply(operator, out)
    return Expression(sorted(set(names)), min(out), True) if out else Expression()


class Scanner:
    """The two automata: phrases over space-joined words, tags over raw text."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
            self.words.add_word(f" {phrase} ", (label, phrase in BASE_PHRASES, len(phrase) + 1))
        self.words.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        joined = b" %b " % b" ".join(words) if words else b""
        base, labels, degrees, starts, at, word = set(), set(), [], [], 0, 0
        found = sorted((end - length, label, is_base) for end, (label, is_base, length) in self.words.iter(joined.decode("latin-1")))
        for start, label, is_base in found:
            word += joined.count(b" ", at, start)  # words before the match
            at = start
            labels.add(label)
            degrees.append(freedom(label))
            if is_base:
                base.add(label)
                starts.append(word)
        if text:
            raw = text.encode().lower().decode("latin-1")
            line_end = -1
            for end, tag in self.tags.iter(raw):
                if line_end <= end:  # one search per line, however many tags it holds
                    line_end = raw.find("\n", end + 1)
                    line_end = len(raw) if line_end < 0 else line_end
                expression = evaluate(raw, end + 1, line_end, tag in LOOSE_TAGS)
                if expression.valid and (tag not in LOOSE_TAGS or expression.names[0] in FREEDOM or any(freedom(n) != UNKNOWN for n in expression.names)):
                    labels.update(expression.names)
                    degrees.append(expression.degree)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(degrees, default=0.0),
        }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base phrase places, labels and score.

    ``score`` is the lowest degree (0 to 1) over all statements found, as all of
    them apply; 0 if there is none.  Rows stay as they are: repeated rows give
    repeated results, a null or empty text has no words, labels "" and score 0,
    a null ``doc_id`` is carried, other columns are not read.  An empty table
    gives an empty result.  No shuffle; a document is scanned in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for start, n, texts in slices(batch, "text"):
                rows = [scanner.scan(t) for t in texts]
                columns = {name: [r[name] for r in rows] for name in _ARROW.names[1:]}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(start, n), **columns}, schema=_ARROW)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, {FIELDS}")
