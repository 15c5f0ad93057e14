"""File formats: raw, NRRD and GIPL volumes, PNG slices, NML skeletons, zipped merge lists, PLY meshes.

Decoders take bytes, so Spark's ``binaryFile`` source reads any store; encoders give bytes.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.sources.blocks import DTYPES

#: GIPL image type codes.
_GIPL = {1: "|b1", 7: "|i1", 8: "|u1", 15: ">i2", 16: ">u2", 31: ">u4", 32: ">i4", 64: ">f4", 65: ">f8"}
_GIPL_MAGIC = 4026526128
#: NRRD type names.
_NRRD = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "uint": "u4", "uint32": "u4", "unsigned int": "u4", "uint64": "u8", "short": "i2", "int16": "i2", "int": "i4", "int32": "i4", "int64": "i8", "float": "f4", "double": "f8"}


def read_raw(data: bytes, shape: tuple[int, int, int], dtype: str, big_endian: bool = False) -> np.ndarray:
    kind = np.dtype(DTYPES[dtype])
    return np.frombuffer(data, kind.newbyteorder(">") if big_endian else kind).reshape(shape[::-1]).astype(kind)


def write_raw(cube: np.ndarray, big_endian: bool = False) -> bytes:
    return cube.astype(cube.dtype.newbyteorder(">" if big_endian else "<")).tobytes()


def read_nrrd(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n\n")
    lines = head.decode("ascii").splitlines()
    if not lines[0].startswith("NRRD"):
        raise ValueError("no NRRD file")
    fields = dict(re.split(r":=?\s*", x, maxsplit=1) for x in lines[1:] if ":" in x and x[0] != "#")
    kind = np.dtype(_NRRD[fields["type"]]).newbyteorder(">" if fields.get("endian") == "big" else "<")
    if fields["encoding"] in ("gzip", "gz"):
        body = zlib.decompress(body, 31)
    return np.frombuffer(body, kind).reshape([int(x) for x in fields["sizes"].split()][::-1])


def write_nrrd(cube: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    name = next(k for k, v in _NRRD.items() if v == cube.dtype.str[1:])
    head = f"NRRD0004\ntype: {name}\ndimension: 3\nsizes: {' '.join(map(str, cube.shape[::-1]))}\nspacings: {' '.join(map(str, spacing))}\nencoding: gzip\nendian: little\n\n"
    packer = zlib.compressobj(wbits=31)
    return head.encode() + packer.compress(write_raw(cube)) + packer.flush()


def read_gipl(data: bytes) -> np.ndarray:
    """Header of 256 bytes, big-endian: sizes, type, pixel sizes; a magic number ends it."""
    sizes = struct.unpack_from(">4H", data, 0)
    if struct.unpack_from(">I", data, 252)[0] != _GIPL_MAGIC:
        raise ValueError("no GIPL file")
    kind = np.dtype(_GIPL[struct.unpack_from(">H", data, 8)[0]])
    return np.frombuffer(data, kind, offset=256, count=int(np.prod(sizes[:3], dtype=np.int64))).reshape(sizes[2::-1]).astype(kind.newbyteorder("<"))


def write_gipl(cube: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    code = next(k for k, v in _GIPL.items() if np.dtype(v) == cube.dtype.newbyteorder(">"))
    head = bytearray(256)
    struct.pack_into(">4HH4f", head, 0, *cube.shape[::-1], 1, code, *spacing, 1.0)
    struct.pack_into(">I", head, 252, _GIPL_MAGIC)
    return bytes(head) + cube.astype(cube.dtype.newbyteorder(">")).tobytes()


#: Tags of a TIFF directory.
_TIFF = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "format": 339}
_TIFF_KINDS = {"u": 1, "i": 2, "f": 3}


def write_tiff(cube: np.ndarray) -> bytes:
    """Grey pages, one a plane, uncompressed, little-endian."""
    code = _TIFF_KINDS[cube.dtype.kind]
    out, at = [b"II*\0"], 8
    planes = [p.astype(p.dtype.newbyteorder("<")).tobytes() for p in cube]
    starts = []
    for p in planes:
        starts.append(at)
        at += len(p) + len(p) % 2
    out.append(struct.pack("<I", at if planes else 0))
    out += [p + b"\0" * (len(p) % 2) for p in planes]
    for k, start in enumerate(starts):
        values = {"width": cube.shape[2], "height": cube.shape[1], "bits": 8 * cube.dtype.itemsize, "compression": 1, "photometric": 1, "offsets": start, "samples": 1, "rows": cube.shape[1], "counts": len(planes[k]), "format": code}
        body = b"".join(struct.pack("<HHII", _TIFF[n], 4, 1, v) for n, v in values.items())
        at += 6 + len(body)
        out.append(struct.pack("<H", len(values)) + body + struct.pack("<I", at if k + 1 < len(starts) else 0))
    return b"".join(out)


def read_tiff(data: bytes) -> np.ndarray:
    """Pages of one grey sample, in strips without compression; others raise."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at, planes = struct.unpack_from(f"{end}I", data, 4)[0], []
    while at:
        count = struct.unpack_from(f"{end}H", data, at)[0]
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * k)
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form:
                size = struct.calcsize(form) * n
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{end}I", data, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{end}{n}{form}", data, place)
        if tags.get(_TIFF["compression"], (1,))[0] != 1 or tags.get(_TIFF["samples"], (1,))[0] != 1:
            raise ValueError("only uncompressed grey pages")
        kind = {v: k for k, v in _TIFF_KINDS.items()}[tags.get(_TIFF["format"], (1,))[0]]
        body = b"".join(data[a : a + n] for a, n in zip(tags[_TIFF["offsets"]], tags[_TIFF["counts"]], strict=True))
        planes.append(np.frombuffer(body, f"{end}{kind}{tags[_TIFF['bits']][0] // 8}").reshape(tags[_TIFF["height"]][0], tags[_TIFF["width"]][0]))
        at = struct.unpack_from(f"{end}I", data, at + 2 + 12 * count)[0]
    return np.stack(planes).astype(planes[0].dtype.newbyteorder("<"))


def constant(shape: tuple[int, int, int], value: float, dtype: str) -> np.ndarray:
    """A cube (x, y, z extents) of one value."""
    return np.full(shape[::-1], value, DTYPES[dtype])


def write_zip(cube: np.ndarray, name: str = "cube.raw") -> bytes:
    """Raw bytes in a zip file."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, write_raw(cube))
    return held.getvalue()


def read_zip(data: bytes, shape: tuple[int, int, int], dtype: str) -> np.ndarray:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return read_raw(z.read(z.namelist()[0]), shape, dtype)


ENCODERS = {"raw": write_raw, "nrrd": write_nrrd, "gipl": write_gipl, "tiff": write_tiff, "zip": write_zip}


def exported_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """``(name, content)``: each stored block as a file of a kind, named by its place; made where the block is."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            cubes = [np.frombuffer(r["data"], DTYPES[r["dtype"]]).reshape(r["sz"], r["sy"], r["sx"]) for r in rows]
            names = ["x{cx:04d}_y{cy:04d}_z{cz:04d}.".format(**r) + kind for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([ENCODERS[kind](c) for c in cubes], pa.binary())], names=["name", "content"])

    return blocks.mapInArrow(run, "name string, content binary")


def mask_bytes(chunks: DataFrame, shape: tuple[int, int, int]) -> bytes:
    """One byte a chunk, 1 where ``(cx, cy, cz)`` is listed, as a raw volume; the list is one row a chunk, not a voxel."""
    cube = np.zeros(shape[::-1], np.uint8)
    for r in chunks.select("cx", "cy", "cz").distinct().toLocalIterator():
        cube[r.cz, r.cy, r.cx] = 1
    return write_raw(cube)


def write_png(plane: np.ndarray) -> bytes:
    """An 8- or 16-bit grey slice."""
    depth = 8 * plane.dtype.itemsize
    rows = b"".join(b"\0" + r.astype(plane.dtype.newbyteorder(">")).tobytes() for r in plane)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def exported(cube: np.ndarray, pad: int = 0, zero_corners: bool = False, gray_to: str | None = None, colours: int = 0, equal: int | None = None, above: float | None = None, fill: float | None = None) -> np.ndarray | None:
    """Export transforms in order: equality or comparison masks, colours, grey rescaling, zeroed corners, padding; None if all is 0."""
    if not cube.any():
        return None
    if equal is not None:
        cube = (cube == equal).astype(np.uint8)
    if above is not None:
        cube = ((cube > above) & (cube != fill if fill is not None else True)).astype(np.uint8)
    if colours:
        cube = np.where(cube == 0, 0, (cube - 1) % colours + 1).astype(cube.dtype)
    if gray_to:
        kind, low, high = np.dtype(DTYPES[gray_to]), float(cube.min()), float(cube.max())
        cube = ((cube - low) / ((high - low) or 1.0) * np.iinfo(kind).max).astype(kind)
    if zero_corners:
        cube = cube.copy()
        cube[np.ix_(*[(0, n - 1) for n in cube.shape])] = 0
    return np.pad(cube, pad) if pad else cube


def read_nml(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(file, tree, node, x, y, z)``, ``(file, tree, src, dst)`` and ``(file, key, attribute, value)`` of NML files (``path``, ``content``)."""
    text = files.select(F.col("path").alias("file"), F.decode("content", "utf-8").alias("xml"))
    things = text.select("file", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<thing\b.*?</thing>"), F.lit(0))).alias("t")).withColumn("tree", F.regexp_extract("t", r'<thing[^>]*\bid="(\d+)"', 1).cast("long"))
    number = lambda tag, key: F.regexp_extract(tag, rf'\b{key}="(-?[\d.]+)"', 1)
    nodes = things.select("file", "tree", F.explode(F.regexp_extract_all("t", F.lit(r"<node\b[^>]*>"), F.lit(0))).alias("n")).select("file", "tree", number("n", "id").cast("long").alias("node"), *[number("n", a).cast("double").cast("int").alias(a) for a in "xyz"])
    edges = things.select("file", "tree", F.explode(F.regexp_extract_all("t", F.lit(r"<edge\b[^>]*>"), F.lit(0))).alias("e")).select("file", "tree", number("e", "source").cast("long").alias("src"), number("e", "target").cast("long").alias("dst"))
    head = F.regexp_extract("xml", r"(?s)<parameters>(.*?)</parameters>", 1)
    tags = text.select("file", F.explode(F.regexp_extract_all(head, F.lit(r"<\w+[^>]*/>"), F.lit(0))).alias("p"))
    pairs = tags.select("file", F.regexp_extract("p", r"<(\w+)", 1).alias("key"), F.explode(F.regexp_extract_all("p", F.lit(r'\b\w+="[^"]*"'), F.lit(0))).alias("a"))
    return nodes, edges, pairs.select("file", "key", F.regexp_extract("a", r"(\w+)=", 1).alias("attribute"), F.regexp_extract("a", r'"([^"]*)"', 1).alias("value"))


def write_nml(nodes: DataFrame, edges: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``(tree, value)``: the XML of each tree, to be framed by ``nml_frame``."""
    n = nodes.select("tree", F.format_string('<node id="%d" x="%d" y="%d" z="%d" radius="1.0"/>', "node", "x", "y", "z").alias("n")).groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list("n")), "").alias("ns"))
    e = edges.select("tree", F.format_string('<edge source="%d" target="%d"/>', "src", "dst").alias("e")).groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("es"))
    return n.join(e, "tree", "left").select("tree", F.format_string('<thing id="%d"><nodes>%s</nodes><edges>%s</edges></thing>', "tree", "ns", F.coalesce("es", F.lit(""))).alias("value"))


def nml_frame(things: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> str:
    x, y, z = scale
    return f'<?xml version="1.0"?><things><parameters><scale x="{x}" y="{y}" z="{z}"/></parameters>{"".join(things)}</things>'


def read_merge_lists(files: DataFrame) -> DataFrame:
    """``(object, svox, scx, scy, scz, level)`` of zipped merge lists: per line an object, two flags, then five numbers per supervoxel."""

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = "".join(z.read(n).decode() for n in z.namelist() if n.endswith("mergelist.txt"))
                for line in text.splitlines():
                    values = line.split()
                    if len(values) < 8 or not all(re.fullmatch(r"-?\d+", v) for v in values):
                        continue
                    numbers = list(map(int, values))
                    out += [(numbers[0], *numbers[i : i + 5]) for i in range(3, len(numbers) - 4, 5)]
            yield pd.DataFrame(out, columns=["object", "svox", "scx", "scy", "scz", "level"])

    return files.select("content").mapInPandas(run, "object long, svox long, scx long, scy long, scz long, level long")


def members_by_superchunk(merges: DataFrame, superchunks: DataFrame) -> DataFrame:
    """Objects' supervoxels with the superchunk that holds them: each superchunk is loaded once."""
    return merges.join(superchunks, ["scx", "scy", "scz", "level"])


def merge_meshes(parts: DataFrame) -> DataFrame:
    """Meshes ``(label, part, vertices, faces, n_vox)`` joined per label: faces count on, boxes and sizes follow."""
    rows = F.array_sort(F.collect_list(F.struct("part", "vertices", "faces")))
    merged = parts.groupBy("label").agg(rows.alias("rows"), F.sum("n_vox").alias("n_vox"))
    step = lambda s, r: F.struct(F.concat(s["v"], r["vertices"]).alias("v"), F.concat(s["f"], F.transform(r["faces"], lambda f: F.struct(*[(f[k] + F.size(s["v"])).cast("int").alias(k) for k in "abc"]))).alias("f"))
    start = F.struct(F.expr("cast(array() as array<struct<x:double,y:double,z:double>>)").alias("v"), F.expr("cast(array() as array<struct<a:int,b:int,c:int>>)").alias("f"))
    merged = merged.withColumn("m", F.aggregate("rows", start, step)).select("label", F.col("m.v").alias("vertices"), F.col("m.f").alias("faces"), "n_vox")
    ends = {f"{n}_{a}": f(F.col("vertices")[a]) for a in "xyz" for n, f in (("min", F.array_min), ("max", F.array_max))}
    return merged.withColumns(ends).withColumn("area", surface_area("vertices", "faces"))


def surface_area(vertices: str, faces: str):
    def one(total, f):
        a, b, c = (F.get(F.col(vertices), f[k]) for k in "abc")
        u, v = [[p[k] - a[k] for k in "xyz"] for p in (b, c)]
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return total + 0.5 * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])

    return F.aggregate(faces, F.lit(0.0), one)


def write_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = np.zeros(len(faces), dtype=[("n", "u1"), ("v", "<i4", 3)])
    body["n"], body["v"] = 3, faces
    return head.encode() + vertices.astype("<f4").tobytes() + body.tobytes()


def label_meshes(blocks: DataFrame, chunk: int = 128) -> DataFrame:
    """``(label, part, vertices, faces, n_vox)``: the closed surface of each label in each block."""
    from voxmill.operators.kernels import surface

    point = pa.struct([(a, pa.float64()) for a in "xyz"])
    face = pa.struct([(a, pa.int32()) for a in "abc"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cube = np.frombuffer(row["data"], DTYPES[row["dtype"]]).reshape(row["sz"], row["sy"], row["sx"])
                base = np.array([row[f"c{a}"] * chunk + row[f"o{a}"] for a in "xyz"])
                part = (row["cz"] << 40) + (row["cy"] << 20) + row["cx"]
                for label in np.unique(cube[cube != 0]):
                    mask = cube == label
                    v, f = surface(mask)
                    yield pa.RecordBatch.from_arrays([pa.array([int(label)]), pa.array([part]), pa.array([[dict(zip("xyz", map(float, p))) for p in v + base]], pa.list_(point)), pa.array([[dict(zip("abc", map(int, t))) for t in f]], pa.list_(face)), pa.array([int(mask.sum())])], names=["label", "part", "vertices", "faces", "n_vox"])

    return blocks.mapInArrow(run, "label long, part long, vertices array<struct<x: double, y: double, z: double>>, faces array<struct<a: int, b: int, c: int>>, n_vox long")
