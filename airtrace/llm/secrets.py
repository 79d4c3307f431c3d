"""Secret scan: patterns first, then candidates confirmed by their structure.

The base patterns (assignments, access keys, long hex) are reported as they
match. Beyond them, base64 (of either alphabet) and hex candidates are decoded
and reported only if what comes out has the nested structure of a key: DER with
lengths that fit inside each other and the fields of a private key, the
length-prefixed strings of an OpenSSH key, or a signed token whose header is
JSON that names an algorithm.

A key is tried wherever its first characters stand, also within a longer run,
and read across line breaks (also written as \\n) as far as its own lengths say.
Symbols that line breaks join are decoded once for each alignment, and every
start is parsed in place in that buffer: a length that leaves it is refused
before anything is copied, so the time does not grow with the number of starts
times the length of the text.
Of dotted parts every three neighbours are tried as a token. A PEM key whose
header lines say that it is encrypted cannot be decoded; it counts if these
lines are complete and the body is whole cipher blocks.

Nulls, empty and odd input: a null text is empty and has no finding; texts of
any length are scanned whole; rows are judged one by one, so null or repeated
ids and further columns do not matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from airtrace.llm.arrow import map_texts
from airtrace.llm.common import packed, require, unpacked

# The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Every other candidate lies within such a run.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: A header starts with a brace, if it does not start where its part does.
HEADER = re.compile(r"e[w-z0-9_-]")
#: A brace and, unless only blanks follow, the quote of a first name or the closing brace.
OPENING = re.compile(r"[ \t\r\n]*\{[ \t\r\n]*[\"}]")
#: Where a key can start: 0x30 and a length from 32 on, or the magic of OpenSSH.
STARTS = (
    ("base64", re.compile(r"M[C-I]|b3BlbnNzaC")),
    ("hex", re.compile(r"(?=30[2-8][0-9A-Fa-f]|6[Ff]70656[Ee]7373682[Dd])")),
)
SYMBOLS = {"base64": re.compile(r"[A-Za-z0-9+/_-]+"), "hex": re.compile(r"[0-9A-Fa-f]+")}
BREAK = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n|\\r)[ \t]*")
PADDING = re.compile(r"={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
PEM_HEADERS = re.compile(r"(?:\s|\\[nr])*((?:[A-Za-z0-9-]+:[^\n\\]*(?:\n|\\r|\\n)+[\r\n]*)+)")
ENCRYPTED = re.compile(r"Proc-Type:[ \t]*4,[ \t]*ENCRYPTED"), re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*[0-9A-Fa-f]{16,}")
OPENSSH = b"openssh-key-v1\0"

SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """Whether the bytes are one sequence with the fields of a private key."""
    if len(data) < 32 or data[0] != SEQUENCE:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    fields = der_items(outer[0][1])
    if not fields:
        return False
    tags = [tag for tag, _ in fields]
    versioned = tags[0] == INTEGER and len(fields[0][1]) == 1 and fields[0][1][0] <= 1
    if versioned and len(tags) >= 6 and all(t == INTEGER for t in tags[:6]):
        return True  # RSA or DSA: version and numbers
    if versioned and tags[1:3] == [SEQUENCE, OCTETS]:
        names = der_items(fields[1][1])
        return bool(names) and names[0][0] == OBJECT_ID  # algorithm and wrapped key
    if versioned and tags[1:2] == [OCTETS] and 16 <= len(fields[1][1]) <= 80:
        return True  # elliptic curve: version and number
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:
        names = der_items(fields[0][1])
        return bool(names) and names[0][0] == OBJECT_ID and len(names) == 2  # encrypted key
    return False


def openssh_end(data: bytes, at: int = 0) -> int:
    """Where the length-prefixed strings after the magic at ``at`` end, or -1 if they do not stay inside the data."""
    if not data.startswith(OPENSSH, at):
        return -1
    at += len(OPENSSH)

    def skip(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) else -1

    for _ in range(3):  # cipher, key derivation and its options
        at = skip(at)
        if at < 0:
            return -1
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return -1
    for _ in range(keys + 1):  # public keys, then the private block
        at = skip(at)
        if at < 0:
            return -1
    return at


def is_openssh(data: bytes) -> bool:
    return openssh_end(data) >= 0


def decoded(text: str) -> bytes:
    """Base64 of either alphabet, padding optional; empty if it cannot be decoded."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_token(header: str, payload: str) -> bool:
    """Whether a token's first part is a JSON header that names an algorithm."""
    try:
        head, body = json.loads(decoded(header)), json.loads(decoded(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def key_kind(data: bytes) -> str | None:
    return "der" if is_private_der(data) else "openssh" if is_openssh(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(kind, *m.span()) for m in pattern.finditer(text, *run.span())]
    return found


def symbols_of(n: int, form: str) -> int:
    return -(-n * 4 // 3) if form == "base64" else 2 * n


class Chain:
    """The symbols from a place on that only line breaks interrupt, decoded once for each alignment."""

    def __init__(self, text: str, at: int, form: str):
        self.form, self.start = form, at
        self.places: list[int] = []  # where each part stands in the text
        self.counts: list[int] = []  # and how many symbols there are before it
        parts, size = [], 0
        while m := SYMBOLS[form].match(text, at):
            parts.append(m[0])
            self.places.append(at)
            self.counts.append(size)
            size += len(m[0])
            self.end = m.end()
            if not (gap := BREAK.match(text, m.end())):
                break
            at = gap.end()
        self.symbols = "".join(parts)
        self.buffers: dict[int, bytes] = {}

    def index(self, place: int) -> int:
        """The number of the symbol at a place of the text."""
        part = bisect_right(self.places, place) - 1
        return self.counts[part] + place - self.places[part]

    def place_after(self, n: int) -> int:
        """Where the first ``n`` symbols end in the text."""
        part = bisect_right(self.counts, n - 1) - 1
        return self.places[part] + n - self.counts[part]

    def data(self, index: int) -> tuple[bytes, int]:
        """A buffer and where in it the symbol's bytes begin."""
        group, width = (4, 3) if self.form == "base64" else (2, 1)
        turn = index % group
        if turn not in self.buffers:
            rest = len(self.symbols) - turn
            # a last symbol that does not fill a byte is none
            symbols = self.symbols[turn:len(self.symbols) - (1 if rest % group == 1 else 0)]
            self.buffers[turn] = decoded(symbols) if self.form == "base64" else bytes.fromhex(symbols)
        return self.buffers[turn], (index - turn) // group * width


def key_at(chain: Chain, at: int) -> tuple[str, int] | None:
    """Kind and number of symbols of the key that starts at the symbol ``at``."""
    data, start = chain.data(at)
    if len(data) - start < 9:
        return None
    if data[start] == SEQUENCE:
        length = data[start + 1]
        width = length & 0x7F if length & 0x80 else 0
        if width > 4 or length == 0x80:
            return None
        inner = start + 2 + width
        size = 2 + width + (int.from_bytes(data[start + 2:inner], "big") if width else length)
        if start + size > len(data) or inner + 3 > len(data):
            return None
        # the first field is a version of one byte or an algorithm
        versioned = data[inner] == INTEGER and data[inner + 1] == 1 and data[inner + 2] <= 1
        if not (versioned or data[inner] == SEQUENCE) or not is_private_der(data[start:start + size]):
            return None
        return "der", symbols_of(size, chain.form)
    if data.startswith(OPENSSH, start):
        end = openssh_end(data, start)
        return None if end < 0 else ("openssh", symbols_of(end - start, chain.form))
    return None


def key_spans(text: str, form: str, starts: re.Pattern) -> Iterator[tuple[str, int, int]]:
    chain, upto = None, 0
    for m in starts.finditer(text):
        if m.start() < upto:
            continue
        if chain is None or m.start() >= chain.end:
            chain = Chain(text, m.start(), form)
        at = chain.index(m.start())
        if key := key_at(chain, at):
            upto = chain.place_after(at + key[1])
            upto = PADDING.match(text, upto).end() if form == "base64" else upto
            yield key[0], m.start(), upto


def token_starts(header: str, payload: str) -> Iterator[int]:
    """Where in a dotted part a header can start that ends with the part.

    The part is decoded once for each alignment. JSON is read in place with every
    byte as a character, which fails at once for almost all starts; the token
    itself is judged afterwards.
    """
    buffers: dict[int, str] = {}
    for i in (0, *(m.start() for m in HEADER.finditer(header, 1))):
        if len(header) - i < 8:
            return
        turn = i % 4
        if turn not in buffers:
            buffers[turn] = decoded(header[turn:]).decode("latin-1")
        body, at = buffers[turn], (i - turn) // 4 * 3
        if OPENING.match(body, at) and _is_object_to_the_end(body, at):
            yield i


def _is_object_to_the_end(body: str, at: int) -> bool:
    """Whether JSON from ``at`` on fills the rest; read in growing windows, as a failure costs the length it is given."""
    window = 256
    while True:
        part = body[at:at + window]
        try:
            json.loads(part)
            return at + window >= len(body)
        except RecursionError:
            return False
        except ValueError as error:
            # an error before the end of the window is one of the whole text too
            cut = error.msg.startswith("Unterminated") or error.pos >= len(part) - 12
            if at + window >= len(body) or not cut:
                return False
        window *= 8


def token_spans(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Signed tokens among the dotted parts of a run."""
    found = []
    for stretch in DOTTED.finditer(text, start, end):
        run = stretch[0].lstrip(".")
        parts, at = run.split("."), stretch.end() - len(run)
        for header, payload, signature in zip(parts, parts[1:], parts[2:]):
            if len(header) >= 8 and len(payload) >= 2 and decoded(payload).strip()[:1] == b"{":
                for i in token_starts(header, payload):
                    if is_signed_token(header[i:], payload):
                        found.append(("jwt", at + i, at + len(header) + len(payload) + len(signature) + 2))
                        break
            at += len(header) + 1
    return found


def pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys between BEGIN and END lines, with or without header lines."""
    found = []
    begins = list(PEM.finditer(text))
    for m, after in zip(begins, [b.start() for b in begins[1:]] + [len(text)]):
        last = f"-----END {m[1]}-----"
        end = text.find(last, m.end(), after)
        if end < 0:
            continue
        headers = PEM_HEADERS.match(text, m.end(), end)
        data = decoded(re.sub(r"\s|\\[nr]", "", text[headers.end() if headers else m.end():end]))
        kind = key_kind(data)
        if headers and not kind and data and len(data) % 8 == 0 and all(p.search(headers[1]) for p in ENCRYPTED):
            kind = "der"
        if kind:
            found.append((kind, m.start(), end + len(last)))
    return found


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = pem_spans(text) if "-----BEGIN " in text else []
    pems = [(a, b) for _, a, b in found]
    for run in RUN.finditer(text):
        found += token_spans(text, *run.span())
    for form, starts in STARTS:
        for kind, start, upto in key_spans(text, form, starts):
            within = any(a <= start and upto <= b for a, b in pems)
            if not (within and BREAK.search(text, start, upto)):  # lines of a key that is listed already
                found.append((kind, start, upto))
    return sorted(set(found))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def _scan(texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
    for text in texts:
        base = base_spans(text)
        kinds = [k for k, _, _ in base]
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(kinds.count(kind))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed(base + confirmed_spans(text)))
    return out


def _mask(texts: list[str]) -> dict[str, list]:
    return {"text": [masked(t) for t in texts]}


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with every finding, overlapping ones together, replaced."""
    out, upto = [], 0
    spans = sorted((a, b) for _, a, b in base_spans(text) + confirmed_spans(text))
    for i, (a, b) in enumerate(spans):
        if a >= upto or i == 0:
            out += [text[upto:a], mask]
        upto = max(upto, b)
    return "".join(out) + text[upto:]


FOUND = StructType(
    [StructField(f"n_{k}", LongType()) for k in KINDS[:3]]
    + [StructField("base_sha256", StringType()), StructField("spans", StringType())]
)


MASKED = StructType([StructField("text", StringType())])


def scan(docs: DataFrame) -> DataFrame:
    """Findings of every document: counts, a digest of the base ones and all spans."""
    require(docs, "doc_id", "text")
    return map_texts(docs.select("doc_id", "text"), "text", _scan, FOUND).drop("text")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All documents, secrets in the text replaced; ``n_chars``, if present, is counted anew."""
    out = map_texts(packed(docs).withColumn("_null", F.col("text").isNull()), "text", _mask, MASKED)
    text = F.when(~F.col("_null"), F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs, **changed)
