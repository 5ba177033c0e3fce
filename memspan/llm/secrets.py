"""Secret scans with a recursive decoding worklist.

Each text is scanned for three kinds of secrets. Encoded parts (URL escapes, Unicode escapes,
base64, and gzip, zlib, bzip2 or xz data whose bytes are written in any of these) are unwrapped into further layers, which
are scanned and unwrapped in turn until nothing new appears. Every layer knows which source
interval each of its characters came from, so a secret found at any depth is reported as a
span of the original text. A layer seen before with the same source interval ends its branch
(a compressed file may contain itself); layers are remembered by their digests.

Escapes of escapes (``%252541``) are peeled to the last one in one step. Escapes that stand for no
character stay as they are, and do not keep their neighbours from being read. Decoded bytes form a layer
if they hold 14 printable ASCII characters in a row, the least that a secret or a further
encoding needs; other bytes among them are characters that no pattern has. Where every second byte is zero (UTF-16),
both halves are layers.

A run of base64 is decoded from its first four characters on, so a payload behind any prefix (``id-``, ``data/``) is read in one of
the four; compressed data are looked for anywhere in the bytes. Raw deflate has no mark by which to find it, and is read where one of the four
begins with it. Bytes written as escapes among plain characters (URL escapes, ``\\x1f`` or ``\\u001f`` and the short ones of
strings; escapes of escapes too) are compressed data if they begin like them and yield the least text that matters.

All characters of a decompressed layer stand for the same source interval, so only the kinds found in it
matter. Compressed data are read as a stream, member after member and through any number of compressions, in
windows of about ``window_bytes`` that end behind a character which no pattern has, so nothing is cut. If there is none in
four windows (one endless run), all of it is also read as one run of base64, as a stream again, and windows
overlap. So memory stays bounded and no layer is left out; ``n_oversize`` counts windows beyond the first.

Defined cases
* null text: the empty string, no spans; a text without encoded parts has its base spans only;
* the same kind and span found in several layers is reported once;
* damaged compressed data are read as far as they go;
* repeated rows are scanned as rows of their own; an empty table gives an empty one; extra columns, whatever their
  names, are not read (``redacted`` keeps them as they are); very long texts are scanned whole.
One row is handled at a time; there is no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import contextlib
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import map_columns

KINDS = ("assign", "access", "hex")
#: The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("passw", "secret", "token", "api")
#: Nothing shorter can hold a secret or an encoding.
LEAST = 14
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
WIDE = re.compile(rb"\0(?:[\t\n\r\x20-\x7e]\0){12}")
WINDOW_BYTES = 16_000_000
#: Bytes that neighbouring windows of an endless run share.
OVERLAP = 65_536
#: The last character of a window: one that no pattern has, in any layer.
APART = re.compile(rb"[^A-Za-z0-9+/_.=%\\{}\"':\s\0-]")
BLANKS = re.compile(rb" {3,}")
NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/_-]+")

#: Escapes, where an escaped percent sign or backslash in front belongs to the next one.
URL_ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
URL_RUN = re.compile(f"(?:{URL_ESCAPE.pattern})+")
UNICODE_RUN = re.compile(r"\\(?:u005[cC]|x5[cC]|U0000005[cC]|u\{0{0,4}5[cC]\})*(?:u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
#: Runs over both alphabets; one that mixes them is also taken apart.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_PARTS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Lines of base64 (the last may be short), perhaps indented or with escaped line ends.
BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:[ \t]*\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE_END = re.compile(r"[ \t]*\r?\n[ \t]*|(?:\\r)?\\n[ \t]*")
MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x\x01", zlib.decompressobj), (b"x\x5e", zlib.decompressobj), (b"x\x9c", zlib.decompressobj), (b"x\xda", zlib.decompressobj), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor))
#: How compressed data begin behind other bytes.
COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
#: What the first bytes of compressed data are enough to tell.
PROBE = 1024


class Escaped:
    """One way to write bytes in text: how compressed data begin in it, and what stands for one byte."""

    def __init__(self, mark: str, escape: str, short: str, plain: str):
        def byte(value: str) -> str:
            own = chr(int(value, 16))
            return f"(?:{re.escape(own)}|{escape % f'(?i:{value})'})" if re.fullmatch(plain, own) else escape % f"(?i:{value})"

        def either(values) -> str:
            return f"(?:{'|'.join(map(byte, values))})"

        starts = (["1f", "8b"], ["fd", "37", "7a", "58", "5a"], ["42", "5a", "68", [f"3{k}" for k in range(1, 10)], "31", "41", "59", "26", "53", "59"], ["78", ["01", "5e", "9c", "da"]])
        self.mark = mark
        self.begin = re.compile("|".join("".join(either([v] if isinstance(v, str) else v) for v in start) for start in starts))
        self.byte = re.compile(f"{escape % '([0-9A-Fa-f]{2})'}{short}|({plain})")
        self.run = re.compile(f"(?:{escape % '[0-9A-Fa-f]{2}'}{re.sub('[()]', '', short)}|{plain})++")

    def read(self, text: str, start: int, most: int, plus: str) -> tuple[bytes, list[int], int]:
        """At most ``most`` bytes from ``start`` on, the place behind each of them, and how many lead to the last escape."""
        stop = self.run.match(text, start, start + 12 * most).end()
        out, ends, last = bytearray(), [], 0
        for m in islice(self.byte.finditer(text, start, stop), most):
            plain = m[m.re.groups]
            code = m[1] or (m.re.groups == 3 and m[2])
            out.append(ord(plus if plain == "+" else plain) if plain else int(code, 16) if m[1] else SHORT[code])
            ends.append(m.end())
            last = last if plain else len(out)
        return bytes(out), ends, last


#: The short escapes of strings.
SHORT = {"0": 0, "a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "'": 39, "/": 47, "\\": 92}
WRITTEN = (
    Escaped("%", "%%(?:25)*%s", "", r"[A-Za-z0-9_.~!*'()/+-]"),
    Escaped("\\", r"\\(?:u005[cC]|x5[cC])*(?:x|u00)%s", r"|\\([0abtnvfr\"'/\\])", r"[\x20-\x5b\x5d-\xff]"),
)


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind's number, end) of the base findings of one layer."""
    low = text.lower() if len(text) else text
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


class Layer:
    """A decoded text; ``pieces`` are (start in it, source start, source end, step), where step 1
    maps character by character and step 0 maps every character to the whole source interval."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]]):
        self.text, self.pieces = text, pieces

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        lo, hi = 0, len(self.pieces)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.pieces[mid][0] <= i else (lo, mid)
        at, start, end, step = self.pieces[lo]
        return (start + i - at, start + i - at + 1) if step else (start, end)

    def part(self, start: int, end: int, at: int) -> list[tuple[int, int, int, int]]:
        """The pieces of text[start:end], placed at ``at`` of another layer."""
        out, i = [], start
        while i < end:
            lo, hi = 0, len(self.pieces)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if self.pieces[mid][0] <= i else (lo, mid)
            p = self.pieces[lo]
            stop = min(end, self.pieces[lo + 1][0] if lo + 1 < len(self.pieces) else end)
            out.append((at + i - start, p[1] + (i - p[0]) * p[3], p[2] if not p[3] else p[1] + (stop - p[0]), p[3]))
            i = stop
        return out


def substituted(layer: Layer, runs: list[tuple[int, int, str]]) -> Layer:
    """``layer`` with each (start, end, decoded) put in place."""
    text, pieces, size, last = [], [], 0, 0
    for start, end, decoded in runs:
        if start > last:
            pieces += layer.part(last, start, size)
            text.append(layer.text[last:start])
            size += start - last
        s, e = layer.source(start, end)
        pieces.append((size, s, e, 0))
        text.append(decoded)
        size += len(decoded)
        last = end
    if last < len(layer.text):
        pieces += layer.part(last, len(layer.text), size)
        text.append(layer.text[last:])
    return Layer("".join(text), pieces)


def url_layer(layer: Layer) -> Layer | None:
    runs = []
    for m in URL_RUN.finditer(layer.text):
        escapes = list(URL_ESCAPE.finditer(m.group()))
        decoded = bytes(int(e.group(1), 16) for e in escapes).decode(errors="surrogateescape")
        k = 0  # one character at a time, so that spans stay exact
        for c in decoded:
            n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
            if n > 1 or c < "\x80":
                runs.append((m.start() + escapes[k].start(), m.start() + escapes[k + n - 1].end(), c))
            k += n
    return substituted(layer, runs) if runs else None


def unicode_layer(layer: Layer) -> Layer | None:
    found = [(m.start(), m.end(), int(next(filter(None, m.groups())), 16)) for m in UNICODE_RUN.finditer(layer.text)]
    runs, i = [], 0
    while i < len(found):
        start, end, code = found[i]
        i += 1
        if 0xD800 <= code < 0xDC00 and i < len(found) and found[i][0] == end and 0xDC00 <= found[i][2] < 0xE000:
            code = 0x10000 + ((code - 0xD800) << 10) + found[i][2] - 0xDC00
            end = found[i][1]
            i += 1
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            runs.append((start, end, chr(code)))
    return substituted(layer, runs) if runs else None


def _machine(data: bytes):
    return next((make for magic, make in MAGIC if data.startswith(magic)), None)


def _members(chunks: Iterator[bytes], size: int = 1 << 18) -> Iterator[bytes]:
    """What compressed members that follow each other hold, in pieces of up to ``size`` bytes; damage or
    anything else behind a member ends them."""
    machine, held, begun = None, b"", False
    for chunk in chunks:
        held += chunk
        while True:
            if machine is None:
                held = held.lstrip(b"\0") if begun else held  # padding
                make = _machine(held)
                if make is None and len(held) >= 6:
                    return
                if make is None or len(held) < 6:
                    break
                machine, begun = make(), True
            before = machine.copy() if hasattr(machine, "copy") else None
            try:
                out = machine.decompress(held, size)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                if before is not None:  # a byte at a time up to the damage
                    with contextlib.suppress(zlib.error):
                        for b in held:
                            yield before.decompress(bytes((b,)))
                return
            if out:
                yield out
            if machine.eof:
                held, machine = machine.unused_data, None
                continue
            held = getattr(machine, "unconsumed_tail", b"")
            if not held and getattr(machine, "needs_input", not out):
                break


def _inflated(chunks: Iterator[bytes], above: tuple = ()) -> Iterator[bytes]:
    """A stream, decompressed as often as it begins like compressed data; one that holds itself ends, and so
    does one of more than 200 compressions."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 6:
            break
    made = None
    if _machine(head):
        if (mark := _digest(head)) in above or len(above) == 200:
            return
        inner = _members(chain([head], chunks))
        made = next(filter(None, inner), None)
    if made is None:
        yield head
        yield from chunks
    else:
        yield from _inflated(chain([made], inner), (*above, mark))


def _windows(chunks: Iterator[bytes], window: int) -> Iterator[tuple[bytes, bool]]:
    """A stream in windows that end behind a character which no pattern has, and whether one had to end
    elsewhere. Runs of blanks are cut to three, which means the same to all patterns."""
    held, size = [], 0
    searched = 0
    for chunk in chunks:
        held.append(BLANKS.sub(b"   ", chunk))
        size += len(held[-1])
        if size < window or size < searched + window:
            continue
        data = BLANKS.sub(b"   ", b"".join(held))
        at = max((m.end() for m in APART.finditer(data, max(0, len(data) - 4096))), default=0) or max((m.end() for m in APART.finditer(data, searched)), default=0)
        if at:
            yield data[:at], False
            held, size, searched = [data[at:]], len(data) - at, 0
        elif len(data) >= 4 * window:
            yield data, True
            held, size, searched = [data[-OVERLAP:]], OVERLAP, 0
        else:
            held, size, searched = [data], len(data), len(data)
    if size:
        yield b"".join(held), False


def _kinds_of(data: bytes, window: int, tally: dict, seen: set) -> set[int]:
    """The kinds of secrets in some (perhaps compressed) bytes, at any depth."""
    met = set()
    while _machine(data):
        if (mark := _digest(data)) in met:
            return set()
        met.add(mark)
        inner, pieces, size = _members(iter([data])), [], 0
        for piece in inner:
            pieces.append(piece)
            size += len(piece)
            if size > window:
                return _kinds_in(chain(pieces, inner), window, tally, seen)
        if not size:
            break
        data = b"".join(pieces)
    return _kinds_in(iter([data]), window, tally, seen)


def _kinds_in(chunks: Iterator[bytes], window: int, tally: dict, seen: set) -> set[int]:
    """The same of a stream."""
    kinds: set[int] = set()
    stream = _inflated(chunks)
    for k, (data, endless) in enumerate(_windows(stream, window)):
        tally["large"] += k > 0
        kinds |= _kinds_here(data, window, tally, seen)
        if endless:  # the same bytes, and all that follow, as one run of base64
            kinds |= _kinds_in(_decoded(_watched(chain([data], stream), window, kinds, tally, seen)), window, tally, seen)
        if len(kinds) == len(KINDS):
            break
    return kinds


def _kinds_here(data: bytes, window: int, tally: dict, seen: set) -> set[int]:
    return {kind for part in _halves(data) for _, kind, _ in _all_spans(part.decode("latin-1"), window, tally, seen, True)}


def _halves(data: bytes) -> Iterator[bytes]:
    """What of some bytes may be text: all, and every second one of UTF-16."""
    for part in (data, data[::2], data[1::2]) if WIDE.search(data) else (data,):
        if PRINTABLE.search(part):
            yield part


def _watched(chunks: Iterator[bytes], window: int, kinds: set[int], tally: dict, seen: set) -> Iterator[bytes]:
    """The same chunks; all but the first are scanned in overlapping windows."""
    held = None
    for chunk in chunks:
        yield chunk
        if held is None:
            held = chunk[-OVERLAP:]
            continue
        held += chunk
        if len(held) >= window + OVERLAP:
            tally["large"] += 1
            kinds |= _kinds_here(held, window, tally, seen)
            held = held[-OVERLAP:]
    kinds |= _kinds_here(held or b"", window, tally, seen)


def _decoded(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Base64 in chunks, other characters left out."""
    rest = b""
    for chunk in chunks:
        rest += NOT_BASE64.sub(b"", chunk).replace(b"-", b"+").replace(b"_", b"/")
        whole = len(rest) // 4 * 4
        if whole:
            yield base64.b64decode(rest[:whole])
            rest = rest[whole:]
    if len(rest) > 1:
        yield base64.b64decode(rest + b"=" * (-len(rest) % 4))


def _begins(data: bytes, make) -> bool | None:
    """Whether compressed data yield the least that matters, or end; None if more data are needed to tell."""
    machine = make()
    try:
        return len(machine.decompress(data[:PROBE], LEAST)) == LEAST or machine.eof or None
    except (zlib.error, OSError, lzma.LZMAError):
        return False


def _compressed_in(data: bytes) -> Iterator[int]:
    """Where compressed data begin in some bytes: at their start by two bytes alone, elsewhere only if they can be read."""
    if _machine(data):
        yield 0
    for m in COMPRESSED.finditer(data, 1):
        head = data[m.start() : m.start() + PROBE]
        if m.group()[:1] in b"B\xfd" or _begins(head, _machine(head)):
            yield m.start()


def _extent(data: bytes) -> tuple[int, bool]:
    """How many bytes compressed members that follow each other take (0 if the first has no end), and whether the data end
    inside a member."""
    at = 0
    while make := _machine(data[at : at + 6]):
        machine, held = make(), data[at:]
        try:
            while not machine.eof:
                out = machine.decompress(held, 1 << 18)
                held = getattr(machine, "unconsumed_tail", b"")
                if not machine.eof and not held and getattr(machine, "needs_input", not out):
                    return at, True
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        at = len(data) - len(machine.unused_data)
    return at, at == len(data)


def written_kinds(layer: Layer, window: int, tally: dict, seen: set, inside: bool) -> set[tuple[int, int, int]]:
    """Spans of secrets in compressed data whose bytes are written as escapes in ``layer``."""
    found: set[tuple[int, int, int]] = set()
    for form in WRITTEN:
        done = 0
        for m in form.begin.finditer(layer.text) if form.mark in layer.text else ():
            for plus in "+ " if form.mark == "%" else "+":  # a plus sign may stand for a blank
                if m.start() < done:
                    continue
                for most in (48, PROBE):
                    head = form.read(layer.text, m.start(), most, plus)[0]
                    begun = _begins(head, _machine(head) or zlib.decompressobj)
                    if begun is not None:
                        break
                if begun is False or begun is None and head[:1] not in b"B\xfd":
                    continue
                size, cut, most = 0, True, PROBE  # more is read only while the data go on
                while cut:
                    data, ends, last = form.read(layer.text, m.start(), most, plus)
                    size, cut = _extent(data)
                    cut, most = cut and len(data) == most, 4 * most
                if size:
                    done = ends[size - 1]
                data = data[: size or max(last, 1)]
                source = layer.source(m.start(), ends[len(data) - 1])
                key = (_digest(data), *((0, 0) if inside else source))
                if key not in seen:
                    seen.add(key)
                    tally["layers"] += 1
                    found |= {(source[0], kind, source[1]) for kind in _kinds_of(data, window, tally, seen if inside else set())}
    return found


def base64_layers(layer: Layer, window: int, found: set, tally: dict, seen: set, inside: bool) -> Iterator[Layer]:
    """A layer for each run, from each of its first four characters on, that decodes to text; of runs that hold compressed data,
    the kinds of secrets in them go to ``found`` as spans of the source."""
    for start, end, run in _base64_runs(layer.text):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4 if len(run) > 18 else len(run) - 15):
            some = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            if len(some) < 16:
                continue
            data = binascii.a2b_base64(some + "=" * (-len(some) % 4))
            source = layer.source(start + skip, end)
            raw = b""
            if _begins(data, lambda: zlib.decompressobj(-15)):
                raw = next(_raw(data), b"")
            packed = [(data[at:], None) for at in _compressed_in(data)]
            if PRINTABLE.match(raw) or WIDE.search(raw[:4096]) or _machine(raw):
                packed.append((data, _raw))
            for part, reader in packed:
                key = (_digest(part), reader is None, *((0, 0) if inside else source))
                if key not in seen:
                    seen.add(key)
                    tally["layers"] += 1
                    met = seen if inside else set()
                    kinds = _kinds_of(part, window, tally, met) if reader is None else _kinds_in(reader(part), window, tally, met)
                    found |= {(source[0], kind, source[1]) for kind in kinds}
            for half in _halves(data):
                yield Layer(half.decode("latin-1"), [(0, *source, 0)])


def _raw(data: bytes) -> Iterator[bytes]:
    """What raw deflate holds, in pieces, as far as it goes."""
    machine = zlib.decompressobj(-15)
    with contextlib.suppress(zlib.error):
        while data and not machine.eof:
            out = machine.decompress(data, 1 << 18)
            data = machine.unconsumed_tail
            if out:
                yield out


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of runs in a line; and of neighbouring lines, those of one length with and
    without the shorter one behind them, and all of them, as one run."""
    for m in BASE64_RUN.finditer(text):
        run = m.group()
        yield m.start(), m.end(), run
        mixed = ("+" in run or "/" in run) and ("-" in run or "_" in run)
        for pattern in BASE64_PARTS if mixed else ():
            for p in pattern.finditer(run):
                yield m.start() + p.start(), m.start() + p.end(), p.group()
    if "\n" not in text and "\\n" not in text:
        return
    for m in BASE64_LINES.finditer(text):
        lines, at = [], m.start()
        for gap in LINE_END.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        i = 0
        while i < len(lines):
            size, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == size:
                j += 1
            shorter = j < len(lines) and len(text[slice(*lines[j])].rstrip("=")) < size
            for last in (j, j + 1) if shorter else (j,):
                if last > i + 1:
                    yield lines[i][0], lines[last - 1][1], "".join(text[a:b] for a, b in lines[i:last])
            i = j
        yield m.start(), m.end(), "".join(text[a:b] for a, b in lines)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _all_spans(text: str, window: int, tally: dict, seen: set, inside: bool = False) -> set[tuple[int, int, int]]:
    """All spans of a text and of the layers in it; ``inside`` compressed data places do not matter."""
    spans = set(base_spans(text))
    work = [Layer(text, [(0, 0, len(text), 1)])]
    while work:
        layer = work.pop()
        made: list[Layer] = [x for x in (url_layer(layer) if "%" in layer.text else None, unicode_layer(layer) if "\\" in layer.text else None) if x]
        spans |= written_kinds(layer, window, tally, seen, inside)
        made += base64_layers(layer, window, spans, tally, seen, inside)
        for new in made:
            key = (_digest(new.text.encode(errors="surrogatepass")), *((0, 0) if inside else (new.pieces[0][1], new.pieces[-1][2])))
            if not new.text or key in seen:
                continue
            seen.add(key)
            tally["layers"] += 1
            for start, kind, end in base_spans(new.text):
                s, e = new.source(start, end)
                spans.add((s, kind, e))
            work.append(new)
    return spans


def scan(text: str, window: int = WINDOW_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans (both sorted by start, then kind, then end), layers, further windows of long layers."""
    tally = {"layers": 0, "large": 0}
    spans = _all_spans(text, window, tally, set())
    return sorted(base_spans(text)), sorted(spans), tally["layers"], tally["large"]


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    out, last = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[last:start], mark]
        last = end
    return "".join(out) + text[last:]


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """id, counts by kind of base spans, base_spans, spans, n_layers, n_oversize for each row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        def step(ids, texts):
            out: dict[str, list] = {k: [] for k in ("id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_oversize")}
            for key, text in zip(ids, texts, strict=True):
                base, spans, layers, large = scan(text or "", window_bytes)
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                for name, value in zip(out, (key, *counts, joined(base), joined(spans), layers, large), strict=True):
                    out[name].append(value)
            return out

        return step

    schema = f"id {id_type}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, n_oversize long"
    return map_columns(df.select(id_col, text_col), make, schema).withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """``df`` with every secret span of ``text_col`` replaced; other columns untouched, null stays null."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def cleaned(texts):
        return texts.map(lambda t: t if t is None else redact(t, scan(t, window_bytes)[1]))

    return df.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))
