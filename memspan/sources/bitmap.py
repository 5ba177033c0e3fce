"""The match map as a bitmap file: 8-bit palette, plain or run-length encoded, written and read.

The picture has a ruler, a bar for the reference and one for each query; what is drawn comes from
:func:`memspan.operators.mapping.map_pixels`. Bars are drawn and encoded by the tasks, a row of the picture for each
query; the file is put together from them as they come, so no task and no driver ever holds the picture.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.operators.mapping import BAR, CHAR_HEIGHT, CHAR_SPACE, CHAR_WIDTH, GAP, HEADER, MARGIN, V_MARGIN, WIDTH, ruler_marks, sequence_pixels
from memspan.operators.scans import numbered

WHITE, BLACK, GREY = 0, 1, 2
RAMP = 126
_RUN = re.compile(rb"(.)\1{0,254}", re.DOTALL)
#: The strokes of a digit: top, upper left, upper right, middle, lower left, lower right, bottom.
STROKES = ("1110111", "0010010", "1011101", "1011011", "0111010", "1101011", "1101111", "1010010", "1111111", "1111011")


#: The colours at the stops of the two gradients, and how many steps lie between them.
FORWARD_STOPS, FORWARD_STEPS = ((255, 0, 128), (255, 0, 0), (255, 255, 0)), (128, 256)
REVERSE_STOPS, REVERSE_STEPS = ((0, 255, 0), (0, 255, 255), (0, 0, 255), (128, 0, 255)), (256, 256, 128)


def gradient(at: int, width: int, stops: tuple, steps: tuple) -> tuple[int, int, int]:
    """The colour of pixel ``at`` of ``width``: whole steps along the stops, of one channel each."""
    n, base = at * sum(steps) // max(1, width), 0
    for k, (a, b, size) in enumerate(zip(stops, stops[1:], steps, strict=False)):
        if n < base + size or k == len(steps) - 1:
            return tuple(x + (n - base) * ((y > x) - (y < x)) for x, y in zip(a, b, strict=True))
        base += size


def palette() -> list[tuple[int, int, int]]:
    """White, black, grey, then two gradients: forward magenta-red-yellow, reverse green-cyan-blue-purple."""
    colours = [(255, 255, 255), (0, 0, 0), (192, 192, 192)]
    colours += [gradient(i, RAMP, stops, steps) for stops, steps in ((FORWARD_STOPS, FORWARD_STEPS), (REVERSE_STOPS, REVERSE_STEPS)) for i in range(RAMP)]
    return colours + [(0, 0, 0)] * (256 - len(colours))


def gradient_columns(at: Column, width: Column, stops: tuple, steps: tuple) -> Column:
    """An array (red, green, blue): :func:`gradient` for columns."""
    n = F.floor(at * sum(steps) / F.greatest(width, F.lit(1))).cast("int")
    bases = [sum(steps[:k]) for k in range(len(steps))]
    parts = [F.array(*(F.lit(x) + (n - base) * ((y > x) - (y < x)) for x, y in zip(a, b, strict=True))) for a, b, base in zip(stops, stops[1:], bases, strict=False)]
    out = parts[-1]
    for part, end in reversed(list(zip(parts, bases[1:], strict=False))):
        out = F.when(n < end, part).otherwise(out)
    return out


def nearest_colour(red: Column, green: Column, blue: Column, colours: list[tuple[int, int, int]]) -> Column:
    """The palette index with the least sum of absolute differences, the first among equals."""
    table = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(colours)))
    away = F.transform(table, lambda c: F.struct((F.abs(red - c["r"]) + F.abs(green - c["g"]) + F.abs(blue - c["b"])).alias("d"), c["i"].alias("i")))
    return F.array_min(away)["i"]


def rle8_row(row: bytes) -> bytes:
    """Run-length encoding of one row: (count, value) pairs."""
    return b"".join(bytes((len(m.group()), m.group()[0])) for m in _RUN.finditer(row))


def unpacked_row(data: bytes) -> bytes:
    """The row that such pairs stand for."""
    return b"".join(bytes((value,)) * count for count, value in zip(data[::2], data[1::2], strict=True))


def rle8(rows: list[bytes]) -> bytes:
    """Run-length encoding of rows from the bottom up: pairs, row and file ends."""
    out = b"".join(rle8_row(row) + b"\0\0" for row in rows)
    return out[:-2] + b"\0\1"


def file_header(width: int, height: int, colours: list[tuple[int, int, int]], compress: bool, size: int) -> bytes:
    """Everything in front of ``size`` bytes of pixels."""
    table = b"".join(struct.pack("<BBBB", b, g, r, 0) for r, g, b in colours)
    offset = 14 + 40 + len(table)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, int(compress), size, 2835, 2835, len(colours), 0)
    return b"BM" + struct.pack("<IHHI", offset + size, 0, 0, offset) + info + table


def bitmap_bytes(rows: list[bytes], colours: list[tuple[int, int, int]], compress: bool = False) -> bytes:
    """A bitmap file of equally long rows of palette indices, given from the top down."""
    height, width = len(rows), len(rows[0])
    upward = rows[::-1]
    data = rle8(upward) if compress else b"".join(r + b"\0" * (-width % 4) for r in upward)
    return file_header(width, height, colours, compress, len(data)) + data


def bitmap_info(data: bytes) -> dict[str, int | str]:
    """The fields of a bitmap file's two headers, by name."""
    names = ("filetype", "filesize", "reserved1", "reserved2", "dataoffset", "headersize", "width", "height", "planes", "bits", "compression", "datasize", "horizontal", "vertical", "colours", "important")
    fields = dict(zip(names, struct.unpack("<2sIHHIIiiHHIIiiII", data[:54]), strict=True))
    return fields | {"filetype": fields["filetype"].decode("latin-1")}


def bitmap_rows(data: bytes) -> list[bytes]:
    """The rows of palette indices of an 8-bit bitmap file, from the top down."""
    info = bitmap_info(data)
    width, at, rows = info["width"], info["dataoffset"], []
    if not info["compression"]:
        step = width + -width % 4
        return [data[at + k * step : at + k * step + width] for k in range(info["height"])][::-1]
    row = bytearray()
    while len(rows) < info["height"]:
        count, value = data[at], data[at + 1]
        at += 2
        if count:
            row += bytes([value]) * count
        elif value in (0, 1):  # the end of a row, of the picture
            rows.append(bytes(row))
            row = bytearray()
        else:
            row += data[at : at + value]
            at += value + value % 2
    return rows[::-1]


class Picture:
    """Rows of pixels, drawn from the top left corner; what lies outside is not drawn."""

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height
        self.rows: list[bytearray] = [bytearray(width) for _ in range(height)]

    def fill(self, x: int, y: int, wide: int, high: int, colour: int) -> None:
        left, right = max(0, x), min(self.width, x + wide)
        for row in self.rows[max(0, y) : max(0, min(self.height, y + high))]:
            row[left:right] = bytes([colour]) * max(0, right - left)

    def frame(self, x: int, y: int, wide: int, high: int, colour: int) -> None:
        for part in ((x, y, wide, 1), (x, y + high - 1, wide, 1), (x, y, 1, high), (x + wide - 1, y, 1, high)):
            self.fill(*part, colour)

    def number(self, value: int, x: int, y: int, colour: int) -> None:
        """Digits by strokes, centred at ``x``."""
        said = str(value)
        x = max(1, x - (len(said) * CHAR_WIDTH + (len(said) - 1) * CHAR_SPACE) // 2)
        right, middle, low = CHAR_WIDTH - 1, CHAR_HEIGHT // 2, CHAR_HEIGHT - 1
        spots = ((0, 0, CHAR_WIDTH, 1), (0, 0, 1, middle), (right, 0, 1, middle), (0, middle, CHAR_WIDTH, 1), (0, middle, 1, middle), (right, middle, 1, middle), (0, low, CHAR_WIDTH, 1))
        for k, digit in enumerate(said):
            for there, (dx, dy, wide, high) in zip(STROKES[int(digit)], spots, strict=True):
                if there == "1":
                    self.fill(x + k * (CHAR_WIDTH + CHAR_SPACE) + dx, y + dy, wide, high, colour)


def bar_top(place: int) -> int:
    """The first row of the bar at ``place``: 0 the reference, then the queries."""
    return V_MARGIN + HEADER + place * (BAR + GAP)


def colour_of(strand: str, ref_pixel: int, ref_pixels: int) -> int:
    """The palette index of a pixel of the reference on one strand."""
    return (3 if strand == "+" else 3 + RAMP) + min(RAMP - 1, ref_pixel * RAMP // max(1, ref_pixels))


def map_bars(pixels: DataFrame, queries: DataFrame, ref_size: int, most: int, width: int = WIDTH) -> DataFrame:
    """query_id, place (1-based, by id), line and frame of each query (id, a number, and size): one row of its bar and of the frame
    above and below, run-length encoded. Every matched pixel has the colour of the reference pixel it comes from,
    the rest of the bar is grey; ``most`` is the size of the longest sequence."""
    ref_pixels = sequence_pixels(ref_size, most, width)
    step = F.least(F.lit(RAMP - 1), F.floor(F.col("ref_pixel") * RAMP / max(1, ref_pixels)))
    coloured = pixels.where(F.col("pixel") < width - MARGIN).select("query_id", F.struct(F.col("pixel").cast("int").alias("pixel"), (F.when(F.col("strand") == "+", 3).otherwise(3 + RAMP) + step).cast("int").alias("colour")).alias("p"))
    lists = coloured.groupBy("query_id").agg(F.collect_list("p").alias("dots"))  # at most ``width``
    placed = numbered(queries.select(F.col("id").alias("query_id"), "size", F.lit(0).alias("_all")), ("_all",), (("query_id", False),), "query_id", "place")
    rows = placed.join(lists, "query_id", "left").select("query_id", "place", "size", "dots")
    id_type = rows.schema["query_id"].dataType.simpleString()

    def drawn(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for size, dots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = min(sequence_pixels(size, most, width), width - MARGIN)
                frame = bytearray(width)
                frame[MARGIN - 1 : MARGIN + n + 1] = bytes([BLACK]) * (min(MARGIN + n + 1, width) - MARGIN + 1)
                line = bytearray(frame)
                line[MARGIN : MARGIN + n] = bytes([GREY]) * n
                for dot in dots or ():
                    line[MARGIN + dot["pixel"]] = dot["colour"]
                out.append((rle8_row(bytes(line)), rle8_row(bytes(frame))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], names=["query_id", "place", "line", "frame"])

    return rows.mapInArrow(drawn, f"query_id {id_type}, place int, line binary, frame binary")


def map_top(spark: SparkSession, ref_size: int, most: int, width: int = WIDTH) -> list[bytes]:
    """The rows above the first query: a ruler with marks and the reference's colours, forward above, reverse below."""
    picture = Picture(width, bar_top(0) + BAR)
    ref_pixels, whole = sequence_pixels(ref_size, most, width), sequence_pixels(most, most, width)
    picture.fill(MARGIN, V_MARGIN + CHAR_HEIGHT + CHAR_SPACE + CHAR_HEIGHT // 2, whole, 1, BLACK)
    inner = ruler_marks(spark.range(1).select(F.lit(most).cast("long").alias("most")), "most", width)  # at most ``width`` marks
    for mark, pixel in [(1, 0), *((r.mark, r.pixel) for r in inner.orderBy("mark").collect()), (most, whole - 1)]:
        picture.number(mark, MARGIN + pixel, V_MARGIN, BLACK)
        picture.fill(MARGIN + pixel, V_MARGIN + CHAR_HEIGHT + CHAR_SPACE, 1, CHAR_HEIGHT, BLACK)
    half = BAR // 2 - 1
    for x in range(ref_pixels):
        picture.fill(MARGIN + x, bar_top(0), 1, half, colour_of("+", x, ref_pixels))
        picture.fill(MARGIN + x, bar_top(0) + BAR // 2 + 1, 1, half, colour_of("-", x, ref_pixels))
    return [bytes(r) for r in picture.rows]


def map_header(bars: DataFrame, top: list[bytes], width: int = WIDTH) -> DataFrame:
    """header: the file header of a map of these bars, from their number and their summed lengths."""
    blank, above = len(rle8_row(bytes(width))) + 2, sum(len(rle8_row(r)) + 2 for r in top)
    size = BAR * (F.length("line") + 2) + 2 * (F.length("frame") + 2) + (GAP - 2) * blank
    sums = bars.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"))

    def made(frames):
        for frame in frames:
            heads = [file_header(width, bar_top(n + 1) - GAP + V_MARGIN, palette(), True, size + above + V_MARGIN * blank) for n, size in zip(frame["n"], frame["size"], strict=True)]
            yield frame.assign(header=heads)[["header"]]

    return sums.mapInPandas(made, "header binary")


def write_map(path: str, bars: DataFrame, top: list[bytes], width: int = WIDTH) -> None:
    """The map as a file, from the bottom up, bar by bar as they arrive."""
    blank, end = rle8_row(bytes(width)), b"\0\0"
    with open(path, "wb") as f:
        f.write(map_header(bars, top, width).first().header)
        below = V_MARGIN - 1
        for bar in bars.orderBy(F.desc("place")).toLocalIterator():
            f.write((blank + end) * below + bar.frame + end + (bar.line + end) * BAR + bar.frame + end)
            below = GAP - 2
        f.write((blank + end) * (below + 1))
        f.write(rle8(top[::-1]))
