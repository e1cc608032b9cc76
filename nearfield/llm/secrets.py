"""Secret scans: plain patterns, and structural confirmation of encoded keys and tokens.

Three patterns find assignments, access keys and hex strings. On top of these, base64 and hex are
decoded and reported only if the bytes parse: a DER key (nested lengths must fill their parents
exactly), an SSH key (length-prefixed fields), or a signed token whose header is a JSON object that
names its algorithm.

Lines are joined before decoding, whether they end in a line break or in an escaped one, and a key may
begin at any character that can begin one, so what is glued in front does not hide it. A DER key and an
OpenSSH container end where their lengths say; another SSH key has to end where its line does. Other
well-formed DER, such as a certificate, is passed over as a whole.

Null and empty texts have no spans. Overlapping spans of different kinds are all reported. Positions
are code points, ends exclusive. Repeated rows are scanned alike; extra columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
MASK = "[secret]"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile(
    f"(?:{'|'.join(map(_either_case, _WORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# What may part the lines of one key: line breaks, escaped ones, and the backslash of an escaped slash.
_WRAP = r"(?:[ \t]*+(?:(?:\r?\n|\r|(?:\\++r)?\\++n)[ \t]*+){1,2}+|\\++(?=/))"
_GAP = re.compile(_WRAP)
_LEAST_CHARS = 24
# An encoded brace, then a quote or white space.
_BRACE = re.compile(r"e(?:y[A-DI-L]|w[k-r0-3])")
_BLANK = re.compile(r"\s*")
_HEADER = re.compile(r"[A-Za-z0-9_-]{8,}+")
_REST = re.compile(r"\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY|[A-Z0-9 ]*PUBLIC KEY)-----")
_HINTS = ("passw", "secret", "token", "api")

_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID = 0x30, 0x02, 0x03, 0x04, 0x06
_MOST_ITEMS = 64  # several times what any key holds; keeps the work on hostile texts linear
_CONTAINER = b"openssh-key-v1\0"
# Fields of an SSH key after which it can end; two are the least of any.
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2}


def _item(data: bytes, start: int, end: int) -> tuple[int, int, int] | None:
    """The DER item (tag, start, end) at the start of ``data[start:end]``, else None."""
    if end - start < 2:
        return None
    tag, size = data[start], data[start + 1]
    start += 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or end - start < width:
            return None
        size = int.from_bytes(data[start : start + width], "big")
        start += width
    return None if size > end - start else (tag, start, start + size)


def _items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """DER items (tag, start, end) that fill ``data[start:end]`` exactly, else None."""
    found = []
    while start < end:
        item = _item(data, start, end)
        if not item or len(found) == _MOST_ITEMS:
            return None
        found.append(item)
        start = item[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that holds what a private or public key holds, with all nested lengths right."""
    outer = _item(data, 0, len(data))
    return bool(outer) and outer[2] == len(data) and outer[0] == _SEQUENCE and _holds_key(data, *outer[1:])


def _holds_key(data: bytes, start: int, end: int) -> bool:
    inner = _items(data, start, end)
    if not inner:
        return False
    tags = [tag for tag, _, _ in inner]
    if tags[0] == _INTEGER:
        if len(inner) == 9 and set(tags) == {_INTEGER}:  # a private RSA key
            return True
        if tags[:2] == [_INTEGER, _OCTETS]:  # a private key on a curve
            return inner[0][2] - inner[0][1] == 1 and inner[1][2] - inner[1][1] >= 16
    at = 1 if tags[0] == _INTEGER else 0
    if len(tags) > at + 1 and tags[at] == _SEQUENCE and tags[at + 1] in (_OCTETS, _BITS):
        named = _items(data, *inner[at][1:])  # an algorithm, then the key in its own encoding
        return bool(named) and named[0][0] == _OID
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private container, or length-prefixed fields that begin with a key type."""
    if data.startswith(_CONTAINER):
        return True
    fields, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 or size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def _base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _field_end(data: bytes, at: int) -> int | None:
    """Where the length-prefixed field that begins at ``at`` ends, if it is all there."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return end if at + 4 <= len(data) and end <= len(data) else None


def _container_end(data: bytes, at: int) -> int | None:
    """Where the OpenSSH container that begins at ``at`` ends, if it is all there."""
    names = at = at + len(_CONTAINER)
    for _ in range(3):  # cipher, key derivation and its options
        if (at := _field_end(data, at)) is None:
            return None
    cipher = data[names + 4 : _field_end(data, names)]
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):  # public keys, then the private ones
        if (at := _field_end(data, at)) is None:
            return None
    return min(at + 16, len(data)) if b"gcm" in cipher or b"poly1305" in cipher else at  # a closing tag


def _ssh_ends(data: bytes, at: int) -> Iterator[int]:
    """Ends of fields at which an SSH key that begins at ``at`` can end."""
    n, kind = 0, None
    while (end := _field_end(data, at)) is not None:
        kind = kind or data[at + 4 : end]
        n, at = n + 1, end
        if n == 1 and not kind.startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return
        if n >= _SSH_FIELDS.get(kind, 2):
            yield at


class _Code:
    """One way of writing bytes: ``chars`` characters for every ``size`` bytes.

    ``begins`` finds where a key may begin in joined lines; ``hints`` finds the same in whole texts,
    but needs fewer characters, as a line may end behind them.
    """

    def __init__(self, chars: int, size: int, letters: str, hints: str, begins: str, read: Callable):
        self.chars, self.size, self.read = chars, size, read
        self.hints, self.begins = re.compile(hints), re.compile(f"(?={begins})")
        self.block = re.compile(f"[{letters}]++(?:{_WRAP}[{letters}]++)*+")

    def length(self, size: int) -> int:
        """Characters of so many bytes, without padding."""
        return -(-size * self.chars // self.size)


def _whole_groups(text: str) -> bytes:
    return _base64(text if len(text) % 4 != 1 else text[:-1]) or b""


# A SEQUENCE with its length, the OpenSSH container, and the length and begin of an SSH key's type.
_CODES = (
    _Code(
        4, 3, "A-Za-z0-9+/_-", "M(?:[A-H]|I[E-T])|b3Bl|AAAA",
        "M(?:[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA|AAAA.(?:[HXn3]N(?:zaC|rL)|[GWm2]VjZHNhL)", _whole_groups,
    ),
    _Code(
        2, 1, "0-9a-fA-F", "30(?:8[1-4]|[0-7][0-9a-fA-F])|6[fF]70|000000",
        "30(?:8[1-4]|[0-7][0-9a-fA-F])|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100"
        "|000000..(?:7373682[dD]|65636473612[dD]|736[bB]2[dD])",
        lambda text: bytes.fromhex(text[: len(text) & ~1]),
    ),
)


def _key_at(data: bytes, at: int, ends: Callable[[int], int | None]) -> tuple[str | None, int] | None:
    """The kind and end of the key that begins at ``at``; the kind is None for DER to be passed over.

    ``ends(n)`` is where the line ends behind byte ``n``, if nothing of it is left there.
    """
    if data.startswith(_CONTAINER, at):
        return "ssh", _container_end(data, at) or -1
    if data[at] != _SEQUENCE:
        return next((("ssh", end) for end in _ssh_ends(data, at) if ends(end)), None)
    item = _item(data, at, len(data))
    if not item or item[2] <= item[1] or data[item[1]] not in (_INTEGER, _SEQUENCE):
        return None
    if _holds_key(data, *item[1:]):
        return "der", item[2]
    return (None, item[2]) if item[1] - at > 2 and _items(data, *item[1:]) else None


def _keys(text: str, code: _Code) -> Iterator[tuple[int, int, str]]:
    at = 0
    while hint := code.hints.search(text, at):
        block = code.block.match(text, hint.start())
        start, at = block.span()
        if at - start >= _LEAST_CHARS:
            yield from _keys_of(text, start, at, code)


def _keys_of(text: str, start: int, end: int, code: _Code) -> Iterator[tuple[int, int, str]]:
    """Keys in the lines ``text[start:end]``, which are joined first."""
    gaps = [g.span() for g in _GAP.finditer(text, start, end)]
    lines = list(zip([start, *(b for _, b in gaps)], [*(a for a, _ in gaps), end], strict=True))
    joined = "".join(text[a:b] for a, b in lines)
    first = [0]  # where each line begins in the joined ones
    for a, b in lines:
        first.append(first[-1] + b - a)
    breaks = set(first)
    place = lambda j: lines[k := bisect_right(first, j) - 1][0] + j - first[k]
    read, done = {}, 0
    for begin in code.begins.finditer(joined):
        j = begin.start()
        if j < done:
            continue
        shift = j % code.chars
        if shift not in read:
            read[shift] = code.read(joined[shift:])
        data, byte = read[shift], j // code.chars * code.size
        if byte >= len(data):
            continue
        key = _key_at(data, byte, lambda n, j=j, b=byte: j + code.length(n - b) in breaks)
        if not key:
            continue
        kind, stop = key
        if kind == "ssh" and data.startswith(_CONTAINER, byte):
            # To the end of its line; one that is cut off takes all long lines that follow.
            k = bisect_right(first, j) - 1
            if stop > 0:
                k = bisect_right(first, j + code.length(stop - byte) - 1) - 1
            else:
                k = max([k, *(i for i in range(k, len(lines)) if first[i + 1] - first[i] >= _LEAST_CHARS)])
            last = first[k + 1]
        else:
            last = j + code.length(stop - byte)
        if last - j < _LEAST_CHARS:
            continue
        done = last
        if kind:
            stop = place(last - 1) + 1
            padding = len(text[stop : stop + 2]) - len(text[stop : stop + 2].lstrip("="))
            yield place(j), stop + padding, kind


def _is_signed_header(part: str) -> bool:
    data = _base64(part)
    if not data or not data.startswith(b"{"):
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _is_object(data: str, at: int) -> bool:
    """Whether ``data`` is one JSON object from ``at`` on."""
    try:
        end = json.JSONDecoder().raw_decode(data, at)[1]
    except (ValueError, RecursionError):
        return False
    # Looks no farther than the next character that is no space, and copies nothing.
    return _BLANK.fullmatch(data, end) is not None


def _signed(text: str) -> Iterator[tuple[int, int]]:
    """Tokens whose header may begin anywhere in a dotted segment."""
    end, rest, read, done = 0, None, {}, 0
    for brace in _BRACE.finditer(text):
        at = brace.start()
        if at < done:
            continue
        if at >= end:
            header = _HEADER.match(text, at)
            if not header:
                continue
            end, read = header.end(), {}
            rest = _REST.match(text, end)
        if not rest:
            continue
        # Each of the four alignments of a segment is decoded once, whatever begins in it.
        shift = (end - at) % 4
        if shift not in read:
            read[shift] = at, (_base64(text[at:end]) or b"").decode("latin-1")
        first, data = read[shift]
        if _is_object(data, (at - first) // 4 * 3) and _is_signed_header(text[at:end]):
            done = rest.end()
            yield at, done


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    at, endless = 0, set()
    while begin := _ARMOUR.search(text, at):
        tail = f"-----END {begin[1]}-----"
        # A label without an end here has none farther on.
        end = -1 if tail in endless else text.find(tail, begin.end())
        if end < 0:
            at = begin.end()
            if tail in endless:
                continue
            endless.add(tail)
            if text.find("-----END ", at) < 0:
                return
            continue
        lines = _GAP.sub(lambda g: "\n" if g[0].strip("\\") else "", text[begin.end() : end]).split("\n")
        body = "".join("".join(x.split()) for x in lines if ":" not in x)
        data = _base64(body)
        if data and (is_der_key(data) or is_ssh_key(data)):
            yield begin.start(), end + len(tail)
        at = end + len(tail)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one whole text, by start, then in the order of ``KINDS``."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(*span, "pem") for span in _armoured(text)]
    found += [span for code in _CODES for span in _keys(text, code)]
    found += [(*span, "jwt") for span in _signed(text)]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def mask_spans(text: str, spans: list[tuple[int, int, str]], mask: str = MASK) -> str:
    """The text with every maximal run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCAN_SCHEMA = pa.schema(
    [
        *[(f"n_{kind}", pa.int64()) for kind in BASE_KINDS],
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_confirmed", pa.int64()),
    ]
)


def _scan(id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: [] for name in SCAN_SCHEMA.names}
            for text in batch.column(text_column):
                spans = find_secrets(text.as_py())
                base = [s for s in spans if s[2] in BASE_KINDS]
                for kind in BASE_KINDS:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
                rows["n_confirmed"].append(len(spans) - len(base))
            columns = [pa.array(rows[f.name], type=f.type) for f in SCAN_SCHEMA]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), *columns], names=[id_column, *SCAN_SCHEMA.names]
            )

    return run


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(
        _scan(id_column, text_column),
        f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string,"
        " spans string, n_confirmed long",
    )


def redact_secrets(docs: DataFrame, text_column: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns, with every span in the texts replaced by ``mask``.

    A column ``n_chars`` follows its text. A null text stays null.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = batch.column(at).to_pylist()
            new = [mask_spans(t, s, mask) if (s := find_secrets(t)) else t for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.column(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.coalesce(F.length(text_column).cast(kind), F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out
