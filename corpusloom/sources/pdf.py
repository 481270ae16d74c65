"""Text and ruled tables of PDF files, a file at a time, by the format's public specification (ISO 32000-1).

Read are plain and Flate-compressed streams, object streams, page trees, fonts with a map to Unicode and simple fonts in
the Latin code page. Not read are encrypted files and other filters: such a page is empty, as is one of scanned pictures,
and can be given to an OCR function. Objects are found by looking for them, so that a broken table of offsets does no harm.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.documents import clean_grid, markdown

#: Letters of a page under which it is taken for a scan; the share of pages, and the fewest, that make a line a running one.
SCAN, RUNNING, RUNNING_PAGES = 20, 0.5, 4
RUNNING_LETTERS = range(4, 61)
#: Points by which lines of text, or rules that meet, may miss each other.
NEAR = 3.0

_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<open><<|\[|\{)|(?P<close>>>|\]|\})|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<text>\()|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)|.", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Word(str):
    """An operator or a keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes

    def data(self) -> bytes:
        """The bytes without compression; empty for a filter that is not read."""
        filters = self.head.get("Filter", [])
        filters = filters if isinstance(filters, list) else [filters]
        if any(f not in ("FlateDecode", "Fl") for f in filters):
            return b""
        out = self.raw
        for _ in filters:
            unpack = zlib.decompressobj()
            try:
                out = unpack.decompress(out)
            except zlib.error:
                return b""
        return out


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that opens at `at`, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data) and depth:
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            follows = data[i + 1 : i + 2]
            if follows not in b"\r\n":
                out += _ESCAPED.get(follows, follows)
            i += 2 + (data[i + 1 : i + 3] == b"\r\n")
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
        i += 1
    return bytes(out), i


def parsed(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, where it ends) of what stands at the top level; lists and dictionaries as wholes."""
    stack: list[tuple[bytes, list]] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        at, kind, raw = m.end(), m.lastgroup, m[0]
        if kind is None:
            continue
        if kind == "open":
            stack.append((raw, []))
            continue
        if kind == "close":
            if not stack:
                continue
            opener, items = stack.pop()
            value: object = items
            if opener == b"<<":
                value = {str(k): v for k, v in zip(items[::2], items[1::2])}
        elif kind == "text":
            value, at = _string(data, m.start())
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), raw[1:].decode("latin-1")))
        elif kind == "number":
            value = float(raw) if b"." in raw else int(raw)
        else:
            value = Word(raw.decode("latin-1"))
        if value == "R" and isinstance(value, Word) and stack and len(stack[-1][1]) > 1:
            number = stack[-1][1][-2]
            stack[-1][1][-2:] = [Ref(number)]
        elif stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class File:
    """The objects of a file by number; of several with one number the last counts, as files grow at their end."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.root: object = None
        at = 0
        while m := _OBJECT.search(data, at):
            value, at = next(parsed(data, m.end()), (None, m.end()))
            body = re.compile(rb"\s*stream\r?\n?").match(data, at)
            if body and isinstance(value, dict):
                size = value.get("Length")
                end = body.end() + size if isinstance(size, int) else -1
                if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                    end = data.find(b"endstream", body.end())
                    end = len(data) if end < 0 else end
                value, at = Stream(value, data[body.end() : end]), end
            self.objects[int(m[1])] = value
        for packed in [o for o in self.objects.values() if isinstance(o, Stream) and o.head.get("Type") == "ObjStm"]:
            inner = packed.data()
            first, count = self.get(packed.head.get("First", 0)), self.get(packed.head.get("N", 0))
            places = [v for v, _ in parsed(inner[:first]) if isinstance(v, int)][: 2 * count]
            for number, place in zip(places[::2], places[1::2]):
                self.objects.setdefault(number, next(parsed(inner, first + place), (None, 0))[0])
        self.root = next((o for o in reversed(list(self.objects.values())) if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        self.closed = b"/Encrypt" in data[-4096:]

    def get(self, value: object) -> object:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def part(self, value: object, *names: str) -> object:
        """A value inside dictionaries, null where one lacks it."""
        for name in names:
            value = self.get(value)
            value = value.head if isinstance(value, Stream) else value
            value = value.get(name) if isinstance(value, dict) else None
        return self.get(value)

    def pages(self) -> Iterator[tuple[dict, object]]:
        """(page, resources) in order; resources may come from above."""
        todo, seen = [(self.part(self.root, "Pages"), None)], set()
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = node.get("Resources", above)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(self.get(k), own) for k in reversed(kids)]
            else:
                yield node, own


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


@dataclass
class Font:
    width: int = 1  # bytes of a code
    letters: dict[int, str] = field(default_factory=dict)
    mapped: bool = False

    @classmethod
    def of(cls, file: File, font: object) -> Font:
        out = cls(2 if file.part(font, "Subtype") == "Type0" else 1)
        to_unicode = file.part(font, "ToUnicode")
        if isinstance(to_unicode, Stream):
            out._read(to_unicode.data())
        return out

    def _read(self, cmap: bytes) -> None:
        """Ranges and single codes of a map to Unicode."""
        held: list = []
        for value, _ in parsed(cmap):
            if not isinstance(value, Word):
                held.append(value)
                continue
            if value == "endcodespacerange" and held and isinstance(held[-1], bytes):
                self.width = max(1, len(held[-1]))
            elif value == "endbfchar":
                self.letters |= {int.from_bytes(a): _utf16(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == "endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                    if not (isinstance(low, bytes) and isinstance(high, bytes)):
                        continue
                    for i, code in enumerate(range(int.from_bytes(low), int.from_bytes(high) + 1)):
                        if isinstance(to, list):
                            self.letters[code] = _utf16(to[i]) if i < len(to) and isinstance(to[i], bytes) else ""
                        elif isinstance(to, bytes):
                            self.letters[code] = _utf16(to[:-2]) + chr(int.from_bytes(to[-2:]) + i) if len(to) > 1 else ""
            held = []
        self.mapped = bool(self.letters)

    def text(self, raw: bytes) -> str:
        if self.mapped:
            codes = (int.from_bytes(raw[i : i + self.width]) for i in range(0, len(raw), self.width))
            return "".join(self.letters.get(c, "") for c in codes)
        return raw.decode("cp1252", "replace") if self.width == 1 else ""


Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1, 0, 0, 1, 0, 0)


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _wide(text: str, size: float) -> float:
    """About how wide a text is: as wide as high for letters of East Asia, half of that for others."""
    return size * sum(1.0 if c > "ᄀ" else 0.5 for c in text)


@dataclass
class Run:
    x: float
    y: float
    size: float
    text: str

    @property
    def end(self) -> float:
        return self.x + _wide(self.text, self.size)


class Page:
    """The runs of text and the rules (x0, y0, x1, y1) that a page's content draws."""

    def __init__(self, file: File, node: dict, resources: object) -> None:
        self.runs: list[Run] = []
        self.rules: list[tuple[float, float, float, float]] = []
        self.file = file
        contents = file.get(node.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(s.data() for s in map(file.get, parts) if isinstance(s, Stream))
        self._draw(data, resources, ONE, 0)

    def _draw(self, data: bytes, resources: object, base: Matrix, depth: int) -> None:
        fonts: dict[str, Font] = {}
        state, saved = (base, Font(), 1.0, 0.0), []  # matrix, font, size, leading
        text = line = ONE
        path: list[tuple[float, float, float, float]] = []
        here, args = (0.0, 0.0), []

        def show(parts: list) -> None:
            nonlocal text
            matrix, font, size, _ = state
            for part in parts:
                if isinstance(part, bytes):
                    letters = font.text(part)
                    at = _times(text, matrix)
                    high = abs(size * (at[3] or at[0] or 1))
                    if letters:
                        self.runs.append(Run(at[4], at[5], high, letters))
                    text = _times((1, 0, 0, 1, _wide(letters, size), 0), text)
                elif isinstance(part, (int, float)):
                    if part < -200 and self.runs:
                        self.runs[-1].text += " " * (not self.runs[-1].text.endswith(" "))
                    text = _times((1, 0, 0, 1, -part / 1000 * size, 0), text)

        def down(x: float, y: float) -> None:
            nonlocal text, line
            text = line = _times((1, 0, 0, 1, x, y), line)

        for value, _ in parsed(data):
            if not isinstance(value, Word):
                args.append(value)
                continue
            numbers = [a for a in args if isinstance(a, (int, float))]
            if value == "q":
                saved.append(state)
            elif value == "Q" and saved:
                state = saved.pop()
            elif value == "cm" and len(numbers) == 6:
                state = (_times(tuple(numbers), state[0]), *state[1:])
            elif value == "BT":
                text = line = ONE
            elif value == "Tf" and len(args) == 2 and numbers:
                name = str(args[0])
                if name not in fonts:
                    fonts[name] = Font.of(self.file, self.file.part(resources, "Font", name))
                state = (state[0], fonts[name], float(numbers[0]), state[3])
            elif value == "TL" and numbers:
                state = (*state[:3], float(numbers[0]))
            elif value in ("Td", "TD") and len(numbers) == 2:
                state = (*state[:3], -float(numbers[1])) if value == "TD" else state
                down(*numbers)
            elif value == "Tm" and len(numbers) == 6:
                text = line = tuple(numbers)
            elif value == "T*":
                down(0, -state[3])
            elif value in ("Tj", "'", '"') and args:
                if value != "Tj":
                    down(0, -state[3])
                show(args[-1:])
            elif value == "TJ" and args and isinstance(args[-1], list):
                show(args[-1])
            elif value in ("m", "l") and len(numbers) == 2:
                if value == "l":
                    path.append((*here, *numbers))
                here = tuple(numbers)
            elif value == "re" and len(numbers) == 4:
                x, y, w, h = numbers
                path += [(x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)]
            elif value in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if value != "n":
                    m = state[0]
                    place = lambda x, y: (x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])  # noqa: E731, B023
                    self.rules += [(*place(*p[:2]), *place(*p[2:])) for p in path]
                path = []
            elif value == "Do" and args and depth < 8:
                form = self.file.part(resources, "XObject", str(args[0]))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                    matrix = self.file.get(form.head.get("Matrix")) or ONE
                    self._draw(form.data(), form.head.get("Resources", resources), _times(tuple(matrix), state[0]), depth + 1)
            args = []

    @staticmethod
    def joined(runs: list[Run]) -> list[str]:
        """Runs as lines from above, each from the left; a gap of a quarter of the letters' height is a blank."""
        lines: list[list[Run]] = []
        for run in sorted(runs, key=lambda r: -r.y):
            if lines and abs(lines[-1][0].y - run.y) <= NEAR:
                lines[-1].append(run)
            else:
                lines.append([run])
        out = []
        for line in lines:
            line.sort(key=lambda r: r.x)
            parts = [line[0].text]
            parts += [" " * (b.x - a.end > b.size / 4 and not a.text.endswith(" ")) + b.text for a, b in zip(line, line[1:])]
            out.append(re.sub(r"[ \t ]+", " ", "".join(parts)).strip())
        return [x for x in out if x]

    def lines(self) -> list[str]:
        return self.joined(self.runs)

    def grids(self) -> Iterator[list[list[str]]]:
        """The cells of each group of rules that meet, with two rows and two columns at least."""
        upright = [(x0, min(y0, y1), max(y0, y1)) for x0, y0, x1, y1 in self.rules if abs(x0 - x1) <= 1 and abs(y0 - y1) > NEAR]
        level = [(y0, min(x0, x1), max(x0, x1)) for x0, y0, x1, y1 in self.rules if abs(y0 - y1) <= 1 and abs(x0 - x1) > NEAR]
        boxes: list[tuple[float, float, float, float]] = []
        for box in [(x, a, x, b) for x, a, b in upright] + [(a, y, b, y) for y, a, b in level]:
            # boxes that the new one touches become one with it
            for other in [o for o in boxes if box[0] <= o[2] + NEAR and o[0] <= box[2] + NEAR and box[1] <= o[3] + NEAR and o[1] <= box[3] + NEAR]:
                boxes.remove(other)
                box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
            boxes.append(box)
        for left, low, right, high in sorted(boxes, key=lambda b: -b[3]):
            xs = _apart(x for x, a, b in upright if left - NEAR <= x <= right + NEAR and low - NEAR <= a and b <= high + NEAR)
            ys = _apart(y for y, a, b in level if low - NEAR <= y <= high + NEAR and left - NEAR <= a and b <= right + NEAR)[::-1]
            if len(xs) > 2 and len(ys) > 2:
                inside = lambda x0, x1, top, bottom: [r for r in self.runs if x0 - 1 <= r.x < x1 - 1 and bottom - 1 <= r.y < top - 1]
                yield [["\n".join(self.joined(inside(x0, x1, top, bottom))) for x0, x1 in zip(xs, xs[1:])] for top, bottom in zip(ys, ys[1:])]


def _apart(values: Iterator[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > NEAR:
            out.append(v)
    return out


def running_lines(pages: list[list[str]]) -> set[str]:
    """Lines that are among the first or last two of half of the pages, of four or more."""
    ends = Counter(x for lines in pages for x in lines[:2] + lines[-2:] if len(x) in RUNNING_LETTERS)
    return {x for x, n in ends.items() if len(pages) >= RUNNING_PAGES and n >= RUNNING * len(pages)}


def pdf_blocks(content: bytes, ocr: Callable[[bytes, int], str] | None = None) -> list[tuple[int, str, str, bool]]:
    """(page, kind, text, whether by OCR): the text of each page without running lines, then its tables. Pages are counted
    from 1; empty ones have no block. ocr takes the file and the page. A file that is none gives nothing."""
    file = File(content)
    if file.closed:
        return []
    drawn = [Page(file, node, resources) for node, resources in file.pages()]
    texts = [p.lines() for p in drawn]
    running = running_lines(texts)
    out = []
    for number, (page, lines) in enumerate(zip(drawn, texts), 1):
        read = ocr(content, number) if ocr and sum(map(len, lines)) < SCAN else ""
        body = "\n".join(x for x in (read.split("\n") if read else lines) if x.strip() and x.strip() not in running).strip()
        out += [(number, "text", body, bool(read))] if body else []
        out += [(number, "table", m, False) for grid in page.grids() if (m := markdown(clean_grid(grid)))]
    return out


def pdf_files(files: DataFrame, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """path, pos, page, kind, is_ocr, text: the blocks of files (path, content), in tasks of Arrow batches. A file that
    cannot be read has no rows; null content is such a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = pdf_blocks(content.as_py() or b"", ocr)
                page, kind, text, by_ocr = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(page, pa.int32()), pa.array(kind, pa.string()), pa.array(by_ocr, pa.bool_()), pa.array(text, pa.string())], ["path", "pos", "page", "kind", "is_ocr", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, pos int, page int, kind string, is_ocr boolean, text string")
