"""Secret scan by a recursive decoding worklist.

Each text is scanned, then unwrapped: URL escapes and Unicode escapes are resolved in place; base64 words are
decoded and, where they hold compressed bytes, decompressed. Every new layer goes on the worklist and is scanned and unwrapped
again, until nothing new appears; a layer seen before is not opened again, which ends cycles.
Spans found in a layer are mapped back to the text: character by character through escapes, to
the whole encoded word through base64. The base spans are those of the text itself.

Absent texts count as empty and have no spans; rows that repeat are scanned each; an empty table gives no rows. A
decompressed layer of any size is scanned in windows of ``LAYER`` bytes that end after a line; only a
line longer than that is scanned in windows that overlap by half, and counted in ``oversize``.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from segmentlab.llm.common import per_text

#: Largest part of a decompressed layer that is scanned at a time, in bytes, and bytes decompressed in one step.
LAYER = 64 << 20
_PIECE = 1 << 20
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Maximal runs, so a minimum length in the pattern drops exactly the runs that are too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
# A sign that was escaped many times over ("%252525…", "&#38;#38;…") is read in one step, so a text of nothing else is not as many layers.
_URL = re.compile(r"%(?:25){8,}|(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u005c(?:u005c){8,}|\\x5c(?:x5c){8,}|&#38;(?:#38;){8,}|&#x26;(?:#x26;){8,}|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Heads of gzip, and of zlib without a dictionary; stretches of text that can hold the shortest secret.
_COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_TEXT = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the plain patterns."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text and the way back to the original: pieces (start here, start there, length there, one to one)."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]], above: Layer | None):
        self.text, self.pieces, self.above = text, pieces, above
        self.starts = [p[0] for p in pieces]

    def back(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.above is not None:
            at, there, _, same = layer.pieces[bisect_right(layer.starts, start) - 1]
            first = there + start - at if same else there
            at, there, length, same = layer.pieces[bisect_right(layer.starts, end - 1) - 1]
            start, end, layer = first, there + end - at if same else there + length, layer.above
        return start, end


def _url(run: str) -> str | None:
    if run.startswith("%25252525"):
        return "%"
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _unicode(run: str) -> str | None:
    for escaped, plain in (("\\u005cu005c", "\\"), ("\\x5cx5c", "\\"), ("&#38;#38;", "&"), ("&#x26;#x26;", "&")):
        if run.startswith(escaped):
            return plain
    try:
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if run.startswith("\\u"):
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
        if run.startswith("\\x"):
            return bytes.fromhex(run.replace("\\x", "")).decode()
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return None if 0xD800 <= code < 0xE000 else chr(code)
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def _resolved(layer: Layer, pattern: re.Pattern, read) -> Layer | None:
    """The layer with all escapes of one kind resolved, or None if there are none."""
    out: list[str] = []
    pieces: list[tuple[int, int, int, bool]] = []
    here = last = 0
    for m in pattern.finditer(layer.text):
        plain = read(m[0])
        if not plain:
            continue
        if m.start() > last:
            pieces.append((here, last, m.start() - last, True))
            out.append(layer.text[last:m.start()])
            here += m.start() - last
        pieces.append((here, m.start(), len(m[0]), False))
        out.append(plain)
        here, last = here + len(plain), m.end()
    if not out:
        return None
    if last < len(layer.text):
        pieces.append((here, last, len(layer.text) - last, True))
        out.append(layer.text[last:])
    return Layer("".join(out), pieces, layer)


def _inflated(data: bytes, rest: list[int]) -> Iterator[bytes]:
    """Pieces of a gzip or zlib stream, of all members; none if it is none. ``rest`` gets the number of bytes behind it."""
    while _COMPRESSED.match(data):
        reader = zlib.decompressobj(47)
        try:
            while not reader.eof and (data or reader.unconsumed_tail):
                if piece := reader.decompress(reader.unconsumed_tail or data, _PIECE):
                    yield piece
                data = b""
        except zlib.error:
            return
        if not reader.eof:
            return
        data = reader.unused_data
        rest[:] = [len(data)]


def _opened(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same pieces, decompressed once more as long as they are compressed."""
    pieces = iter(pieces)
    head = next(pieces, b"")
    if not _COMPRESSED.match(head):
        yield head
        yield from pieces
        return

    def inner() -> Iterator[bytes]:
        reader, empty = zlib.decompressobj(47), True
        for piece in itertools.chain([head], pieces):
            while piece:
                if reader.eof:
                    reader = zlib.decompressobj(47)
                try:
                    out = reader.decompress(piece, _PIECE)
                except zlib.error:
                    return
                if out:
                    empty = False
                    yield out
                piece = reader.unused_data if reader.eof else reader.unconsumed_tail
        if empty:
            yield b""

    yield from _opened(inner())


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """Texts of at most about ``LAYER`` bytes, and whether a line was cut (told once).

    A window ends after a line, as no secret crosses one; a line that is longer is scanned in halves that overlap.
    """
    held, told = b"", False
    for piece in pieces:
        held += piece
        while len(held) > LAYER:
            end = held.rfind(b"\n", 0, LAYER) + 1
            yield held[:end or LAYER].decode(errors="replace"), not end and not told
            told = told or not end
            held = held[end or LAYER // 2:]
    yield held.decode(errors="replace"), False


def _decoded(core: str, at: int) -> bytes:
    part = core[at:]
    part = part[:len(part) - (len(part) % 4 == 1)]
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _words(word: str) -> Iterator[tuple[str, int, int, bool]]:
    """Texts in a base64 word, through any compression: text, start and end in the word, whether it was cut in a line.

    Where the whole word is no text, each of the four alignments is read, so a payload glued to a path or a name is found too:
    compressed streams wherever they begin, and stretches of text that are long enough for a secret.
    """
    core = word.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 != 1:
        data = _decoded(core, 0)
        if not _COMPRESSED.match(data):
            try:
                text = data.decode()
            except UnicodeDecodeError:
                text = ""
            if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text):
                yield text, 0, len(word), False
                return
    for at in range(min(4, len(core))):
        data = _decoded(core, at)
        here = 0
        while m := _COMPRESSED.search(data, here):
            here, rest, any_ = m.start() + 1, [0], False
            first = at + m.start() * 4 // 3
            for text, cut in _windows(_opened(_inflated(data[m.start():], rest))):
                if text:
                    any_ = True
                    yield text, first, len(word), cut
            if any_ and rest[0]:
                here = len(data) - rest[0]
            elif any_ and m.start() == 0 and at == 0:
                return
        for m in _TEXT.finditer(data):
            yield m[0].decode(errors="replace"), at + m.start() * 4 // 3, min(len(word), at - (-m.end() * 4 // 3)), False


def all_spans(text: str, base: list[Span] | None = None) -> tuple[set[Span], int]:
    """Spans of the text and of every layer below it, and the number of layers with a line too long to be scanned in one go."""
    found = set(base_spans(text) if base is None else base)
    top, seen, oversize = Layer(text, [], None), {_key(text, (0, len(text)))}, 0
    work: list[Iterator[tuple[Layer, bool]]] = [iter([(top, False)])]
    while work:
        # One window at a time; what is below it comes before the next.
        if (entry := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, cut = entry
        oversize += cut
        if layer is not top:
            # The same word at two places is opened at both; a layer that comes back at its own place is a cycle.
            key = _key(layer.text, layer.back(0, len(layer.text)))
            if key in seen:
                continue
            seen.add(key)
            found |= {(*layer.back(s, e), kind) for s, e, kind in base_spans(layer.text)}
        work.append(_below(layer))
    return found, oversize


def _key(text: str, place: tuple[int, int]) -> tuple[bytes, tuple[int, int]]:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest(), place


def _below(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers one step below, and whether a line was cut for them."""
    text = layer.text
    if "%" in text and (new := _resolved(layer, _URL, _url)):
        yield new, False
    if ("\\" in text or "&#" in text) and (new := _resolved(layer, _UNICODE, _unicode)):
        yield new, False
    for m in _BASE64.finditer(text):
        for plain, start, end, cut in _words(m[0]):
            yield Layer(plain, [(0, m.start() + start, end - start, False)], layer), cut


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(texts: list[str | None]) -> list[list]:
    rows = []
    for text in texts:
        base = base_spans(text := text or "")
        spans, oversize = all_spans(text, base)
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), oversize))
    return [list(c) for c in zip(*rows)]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, oversize."""
    return per_text(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, oversize int", lambda: scan)
