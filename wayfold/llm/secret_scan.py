"""Secret scans by assignment-aware lexing.

Base detectors give three kinds of spans (assign, access, hex). The lexer then reads source and configuration
syntax into name-literal pairs, carries constants from name to name (whichever comes first, also inside concatenations), and scores each literal by how sensitive
its target name is; elements of markup that hold text are pairs as well; literals that score high enough are added as spans of kind "named". Base spans always stay.
A target may have a type (`name: Type = ...`, `var name Type = ...`) and quoted subscripts, which are parts of its name;
names and runs of blanks have any length. Repeats are possessive, so lexing takes linear time.

Defined cases: a null text counts as empty and has no spans; rows that repeat an id are scanned each on their own;
columns other than doc_id and text are not read. Spans are (start, end) in code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, out

# The base patterns and the shortest length that each accepts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "named")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

BLANK = r"[\x20\t]"
#: A dotted or dashed name with quoted, numbered or empty subscripts.
NAME = rf"""[A-Za-z_][A-Za-z0-9_.\-]*+(?:\[{BLANK}*+(?:"[^"'`\[\]\\\n]*+"|'[^"'`\[\]\\\n]*+'|`[^"'`\[\]\\\n]*+`|[0-9]*+){BLANK}*+\])*+"""
#: A target with or without a type, an assignment sign and what follows: a quoted literal (escapes allowed), or a bare value.
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?:(?:var|const){BLANK}++(?P<go>[A-Za-z_][A-Za-z0-9_]*+){BLANK}++[*A-Za-z_\[][*A-Za-z0-9_.\[\]]*+{BLANK}*+=(?![=>])"""
    rf"""|(?P<name>{NAME})(?:["'`](?:{BLANK}*+\])?+)?+{BLANK}*+(?::{BLANK}*+(?P<type>[A-Za-z_&*?(\[](?:[A-Za-z0-9_.,;&'*?!|<>()\[\]\x20\t]|::)*+)=(?![=>])|(?P<sign>:=|=>|[:=])))"""
    rf"""{BLANK}*+(?:(?P<triple>\"{{3}}|'{{3}})|(?:[bBrRuUfF]{{1,2}}(?=["']))?+(?P<q>["'`])(?P<str>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|(?P<bare>[A-Za-z0-9+/_.$@!%&*#~^=\-]++))""",
)
#: The same without types, for what follows a colon and is none.
UNTYPED = re.compile(PAIR.pattern.replace("(?P<type>", "(?!)(?P<type>"))
#: One type: words, marks of references and options, alternatives joined by |, arguments in brackets.
TYPE_WORD = r"(?:[&*?]|'[a-z_]+\s+|(?:mut|dyn|const)\s+)*(?:[A-Za-z_][A-Za-z0-9_.]*(?:::[A-Za-z_][A-Za-z0-9_]*)*)?[?!]?"
TYPE = re.compile(rf"(?=\S){TYPE_WORD}(?:\s*\|\s*{TYPE_WORD})*\s*\Z")
BRACKETS = re.compile(r"([<>\[\]()])")
#: The rest of a triple-quoted literal, over any number of lines.
TRIPLE = {q * 3: re.compile(rf"((?:\\.|[^\\{q}]|{q}(?!{q}{q}))*+){q * 3}", re.S) for q in "\"'"}
SIGN = re.compile(r"[:=]")
#: A further piece of a concatenation: a quoted literal or a name.
MORE = re.compile(rf"""{BLANK}*+\+{BLANK}*+(?:[bBrRuUfF]{{1,2}}(?=["']))?+(?:(?P<q>["'`])(?P<str>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|(?P<bare>[A-Za-z_][A-Za-z0-9_.]*+))""")
#: An element of markup with text only.
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:[\x20\t][^<>\n]*+)?+>([^<>\n]++)</([A-Za-z_][A-Za-z0-9_.:\-]*+)")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")

#: How strongly a part of a name speaks for a secret value.
NAME_WEIGHTS = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "signing": 1.5, "auth": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "salt": 1.0, "bearer": 2.0, "session": 1.0}
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAMED_LEAST_SCORE = 4.0
NAMED_LEAST_LENGTH = 8
PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|change_?me|example|your[_-].*|none|null|true|false|todo|placeholder|<.*>|\$\{.*\})\Z")

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def name_score(name: str) -> float:
    """Sensitivity of a target name: the weights of its parts in snake, kebab, dotted or camel case."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in dict.fromkeys(parts)) + (1.5 if "api" in parts and "key" in parts else 0.0)


def value_score(value: str) -> float:
    """Bits a character, up to 4.5, and a part for mixed character classes; 0 for placeholders and short literals."""
    if len(value) < NAMED_LEAST_LENGTH or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(bits, 4.5) / 1.5 + 0.5 * (classes - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def is_type(words: str) -> bool:
    """Whether words are one type: `Map<String, &str>`, `str | None`, `&'static str`, but not a phrase or a list."""
    depth, flat = 0, []
    for piece in filter(None, BRACKETS.split(words)):
        if piece in "<[(":
            flat += ["_"] * (not depth)
            depth += 1
        elif piece in ">])":
            depth -= 1
            if depth < 0:
                return False
        elif not depth:
            flat.append(piece)
    return not depth and bool(TYPE.match("".join(flat)))


Piece = tuple[str, int, int, bool]  # value, start, end, quoted


def expressions(text: str) -> Iterator[tuple[str, list[Piece]]]:
    """(name, pieces joined by +) for each target; neighbouring literals of a concatenation are one piece."""
    at, stop = 0, -1
    while sign := SIGN.search(text, at):
        # Only lines that hold an assignment sign are lexed.
        line = max(at, text.rfind("\n", at, sign.start()) + 1)
        if stop < sign.end():
            stop = text.find("\n", sign.end())
            stop = len(text) if stop < 0 else stop
        m = PAIR.search(text, line, stop)
        if m and m["type"] and not (is_type(m["type"]) and (m["bare"] is None or m["type"][-1] in " \t")):
            m = UNTYPED.search(text, m.start(), stop)
        if not m:
            at = stop
            continue
        at = m.end()
        names = [m["go"] or m["name"]]
        if m["type"] and IDENTIFIER.match(m["type"].strip()):
            names.append(m["type"].strip())  # `log: token="..."` reads like a type
        if m["bare"]:
            pieces: list[Piece] = [(m["bare"], m.start("bare"), m.end("bare"), False)]
        elif m["triple"]:
            rest = TRIPLE[m["triple"]].match(text, at)
            if not rest:
                continue
            pieces = [(rest[1], rest.start(1), rest.end(1), True)]
            at = rest.end()
        else:
            pieces = [(m["str"], m.start("str"), m.end("str"), True)]
        while (pieces[0][3] or IDENTIFIER.match(pieces[0][0])) and (more := MORE.match(text, at)):
            at = more.end()
            value, start, end, quoted = pieces[-1]
            if more["q"] and quoted:
                pieces[-1] = value + more["str"], start, more.end("str"), True
            else:
                kind = "str" if more["q"] else "bare"
                pieces.append((more[kind], more.start(kind), more.end(kind), bool(more["q"])))
        for name in names:
            yield name, pieces


def elements(text: str) -> Iterator[tuple[str, list[Piece]]]:
    """(name, text) of each element of markup that holds text only."""
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if m[1] == m[3]:
                yield m[1], [(m[2], m.start(2), m.end(2), True)]


def assignments(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) for each piece of each target."""
    for name, pieces in expressions(text):
        for piece in pieces:
            yield name, *piece


class Constants:
    """What names stand for: the last definition before a use, or the first after it; chains of names are followed."""

    def __init__(self, pairs: list[tuple[str, list[Piece]]]):
        self.pairs = pairs
        self.defined: dict[str, list[int]] = {}
        for k, (name, _) in enumerate(pairs):
            self.defined.setdefault(name, []).append(k)
        self.known: dict[int, list[Piece]] = {}

    def definition(self, piece: Piece, use: int) -> int | None:
        value, _, _, quoted = piece
        at = None if quoted or not IDENTIFIER.match(value) else self.defined.get(value)
        if at is None:
            return None
        k = bisect.bisect_left(at, use)
        return at[k - 1] if k else next((x for x in at if x > use), None)

    def literals(self, use: int) -> list[Piece]:
        """The literals that a target gets; a name without a definition stands for itself."""
        if len(self.pairs[use][1]) == 1:  # chains of plain names are followed in a loop, each link once
            way, k = [], use
            while k not in self.known and len(self.pairs[k][1]) == 1:
                self.known[k] = self.pairs[k][1]
                way.append(k)
                following = self.definition(self.pairs[k][1][0], k)
                if following is None:
                    break
                k = following
            end = self.known.get(k) or self.joined(k)
            for k in way:
                self.known[k] = end
            return end
        return self.joined(use)

    def joined(self, use: int) -> list[Piece]:
        """The pieces of a concatenation, each name replaced by its literal if that is a plain one."""
        if use not in self.known:
            self.known[use] = [p for piece in self.pairs[use][1] for k in [self.definition(piece, use)] for p in ([piece] if k is None or len(self.pairs[k][1]) > 1 else self.literals(k))]
        return self.known[use]


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name, directly or through constants assigned from name to name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    pairs = [*expressions(text), *elements(text)]
    constants = Constants(pairs)
    found: dict[tuple[int, int], None] = {}
    for use, (name, pieces) in enumerate(pairs):
        if (sensitive := name_score(name)) <= 0:
            continue
        literals = constants.literals(use)
        strength = value_score("".join(v for v, *_ in literals))
        quoted = all(q for *_, q in literals)
        if strength > 0 and sensitive + strength >= NAMED_LEAST_SCORE and (quoted or strength >= 2.5 or literals != pieces):
            found |= dict.fromkeys((s, e) for v, s, e, q in literals if q or literals == pieces or not IDENTIFIER.match(v))
    return [(s, e, "named") for s, e in found]


def outside(named: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Named spans that lie in no base span; both lists are gone through once, after sorting."""
    base = sorted(base)
    starts, reach = [s for s, *_ in base], list(accumulate((e for _, e, _ in base), max))
    return [x for x in named if not ((k := bisect.bisect_right(starts, x[0])) and reach[k - 1] >= x[1])]


def spelled(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def scan(text: str | None) -> tuple[int, int, int, str, str, int]:
    """Counts of base kinds, digest of the base spans, all spans, and the number of added ones."""
    text = text or ""
    base = base_spans(text)
    named = outside(named_spans(text), base)  # a literal inside a base span is already reported
    kinds = Counter(k for _, _, k in base)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + named), len(named)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs with its secret spans; a map over partitions, without a shuffle."""
    schema = arrow_type(RESULT)

    def task(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            yield out(schema, b.column(0), *(list(zip(*found, strict=True)) or [[]] * 6))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, RESULT)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of text replaced by mask (overlapping spans by one); n_chars, if there, follows."""

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: t if t is None else masked(t, mask))

    done = docs.withColumn("text", cleaned("text"))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def masked(text: str, mask: str) -> str:
    spans = sorted((s, e) for s, e, _ in base_spans(text) + named_spans(text))
    parts, at = [], 0
    for s, e in spans:
        if s >= at:
            parts += [text[at:s], mask]
        at = max(at, e)
    return "".join(parts) + text[at:] if parts else text
