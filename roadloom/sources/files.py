"""Column files, text formats and vendor tables as DataFrames, and back.

A column file is a raw little-endian array without header; its name is the column's, its type the
reader's choice. Files are split at record borders, so large ones are read by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import number_rows

TYPES = {"i8": ("<i1", "tinyint"), "u8": ("<u1", "smallint"), "i16": ("<i2", "smallint"), "u16": ("<u2", "int"), "i32": ("<i4", "int"), "u32": ("<u4", "bigint"), "i64": ("<i8", "bigint"), "f32": ("<f4", "float"), "f64": ("<f8", "double")}


def read_column(spark: SparkSession, path: str, kind: str, name: str = "value") -> DataFrame:
    """idx, value of a column file. Each record of the file is one fixed-length record of the reader."""
    code, sql = TYPES[kind]
    width = np.dtype(code).itemsize
    records = spark.sparkContext.binaryRecords(path, width)  # no DataFrame source cuts a file by record length
    rows = records.zipWithIndex().map(lambda x: (x[1], np.frombuffer(x[0], code)[0].item()))
    return spark.createDataFrame(rows, f"idx bigint, {name} {sql}")


def write_column(df: DataFrame, path: str, kind: str, order: str, value: str) -> None:
    """Write one column in order of another as raw parts that are the file when put together by name."""
    code, _ = TYPES[kind]

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        body = b"".join(p[value].to_numpy(code).tobytes() for p in parts)
        yield pd.DataFrame({"body": [body]})

    ranged = df.select(order, value).repartitionByRange(order).sortWithinPartitions(order)
    ranged.mapInPandas(pack, "body binary").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path)


def read_written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """idx, value of what `write_column` wrote."""
    code, sql = TYPES[kind]
    width = np.dtype(code).itemsize
    parts = spark.read.parquet(path).withColumn("n", F.length("body") / width)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = parts.select("part", before.alias("start"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for body, start in zip(frame["body"], frame["start"]):
                v = np.frombuffer(body, code)
                yield pd.DataFrame({"idx": np.arange(start, start + len(v)), "value": v})

    return parts.join(starts, "part").select("body", "start").mapInPandas(unpack, f"idx bigint, value {sql}")


def graph_from_columns(first_out: DataFrame, head: DataFrame, weight: DataFrame) -> DataFrame:
    """edges from the column files (idx, value) of offsets, heads and any weight."""
    from ..operators.graph import tails_from_offsets

    edges = head.select(F.col("idx").alias("edge_id"), F.col("value").cast("long").alias("head")).join(weight.select(F.col("idx").alias("edge_id"), F.col("value").cast("long").alias("weight")), "edge_id")
    tails = tails_from_offsets(first_out.select(F.col("idx").alias("node_id"), F.col("value").alias("first_out")), edges)
    return edges.join(tails, "edge_id").select("edge_id", "tail", "head", "weight")


def dimacs_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """line, text of a .gr file: a problem line, then an arc per edge with ids from 1."""
    top = edges.agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    head = top.select(F.lit(0).cast("long").alias("line"), F.format_string("p sp %d %d", "n", "m").alias("text"))
    return head.union(edges.select(F.col("edge_id") + 1, F.format_string("a %d %d %d", F.col("tail") + 1, F.col("head") + 1, "weight")))


def coordinate_lines(nodes: DataFrame) -> DataFrame:
    """line, text of a .co file: ids from 1, millionths of a degree."""
    at = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return nodes.select((F.col("node_id") + 1).alias("line"), F.format_string("v %d %d %d", F.col("node_id") + 1, at("lon"), at("lat")).alias("text"))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """tail, head, weight of the arcs of a .gr file."""
    part = F.split("value", " ")
    return spark.read.text(path).where("value like 'a %'").select(*((part[k].cast("long") - int(k < 3)).alias(n) for k, n in ((1, "tail"), (2, "head"), (3, "weight"))))


def ttf_lines(edges: DataFrame, ttf: DataFrame, factor: int = 1) -> DataFrame:
    """line, text per edge of a travel-time text file: tail head k (departure travel-time)*."""
    points = ttf.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    shown = F.array_join(F.transform("p", lambda x: F.concat_ws(" ", (x["dep"] * factor).cast("string"), (x["tt"] * factor).cast("string"))), " ")
    return edges.join(points, "edge_id").select(F.col("edge_id").alias("line"), F.concat_ws(" ", F.col("tail").cast("string"), F.col("head").cast("string"), F.size("p").cast("string"), shown).alias("text"))


def read_ttf_lines(lines: DataFrame) -> DataFrame:
    """tail, head, idx, dep, tt of such lines (column text)."""
    v = F.split("text", " ")
    numbers = lines.select(v[0].cast("long").alias("tail"), v[1].cast("long").alias("head"), F.slice(v, 4, F.size(v)).alias("v"), F.posexplode(F.sequence(F.lit(0), v[2].cast("int") - 1)).alias("idx", "k"))
    return numbers.select("tail", "head", F.col("idx").cast("long").alias("idx"), F.element_at("v", F.col("k") * 2 + 1).cast("long").alias("dep"), F.element_at("v", F.col("k") * 2 + 2).cast("long").alias("tt"))


def query_lines(od: DataFrame) -> DataFrame:
    return od.select(F.col("query_id").alias("line"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("src", "dst", "departure"))).alias("text"))


def read_live_csv(spark: SparkSession, path: str) -> DataFrame:
    """link, tt_ms of live rows with speed, distance and duration; no speed or over five hours: left out."""
    rows = spark.read.csv(path, sep=";", header=True, schema="link bigint, speed double, distance double, duration double")
    return rows.where("speed > 0 and duration <= 18000").select("link", F.floor(F.col("duration") * 1000).cast("long").alias("tt_ms"))


def read_vendor_table(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """A tab-separated table without header, its columns named by position."""
    return spark.read.csv(glob, sep="\t", schema=schema, quote="")


#: Speeds in km/h of the eight vendor speed categories, fastest first; fixed values of the map format.
CATEGORY_KMH = [150, 130, 100, 90, 70, 50, 30, 10]


def import_vendor(links: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """edge_id, tail, head, length_mm, weight_ms from links (link_id, ref, non_ref, direction F/T/B,
    category, limit_kmh, length_m) with both ends in the box (lat0, lon0, lat1, lon1, inclusive).

    Nodes and links get dense ids; both directions become two edges; the speed is the category's, at
    most the limit; the weight is the driving time in whole milliseconds."""
    from ..operators.graph import dense_ids

    inside = nodes.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    ids = dense_ids(inside, "node_id")
    a, b = ids.select(F.col("global_id").alias("ref"), F.col("local_id").alias("u")), ids.select(F.col("global_id").alias("non_ref"), F.col("local_id").alias("v"))
    ways = F.explode(F.when(F.col("direction") == "F", F.array(F.lit(0))).when(F.col("direction") == "T", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    both = links.join(a, "ref").join(b, "non_ref").withColumn("way", ways)
    kmh = F.least(F.element_at(F.lit(CATEGORY_KMH), F.col("category")), F.coalesce("limit_kmh", F.lit(999)))
    tail, head = F.when(F.col("way") == 0, F.col("u")).otherwise(F.col("v")), F.when(F.col("way") == 0, F.col("v")).otherwise(F.col("u"))
    e = both.select("link_id", "way", tail.alias("tail"), head.alias("head"), F.round(F.col("length_m") * 1000).cast("long").alias("length_mm"), F.round(F.col("length_m") * 3600 / kmh).cast("long").alias("weight_ms"))
    return number_rows(e, ["tail", "head", "link_id", "way"], "edge_id").select("edge_id", "tail", "head", "length_mm", "weight_ms")


def smooth_speeds(profile: DataFrame, night_until: int, night_from: int) -> DataFrame:
    """edge_id, slot, kmh: five-minute speeds (edge_id, slot 0..287, kmh, free_flow) with night slots at
    the edge's fastest, at least 5, a circular mean over seven slots, capped by free flow, runs merged."""
    per = Window.partitionBy("edge_id")
    night = (F.col("slot") < night_until) | (F.col("slot") >= night_from)
    fixed = profile.withColumn("kmh", F.greatest(F.lit(5), F.when(night, F.max("kmh").over(per)).otherwise(F.col("kmh"))))
    tripled = fixed.withColumn("pos", F.explode(F.array(F.col("slot") - 288, F.col("slot"), F.col("slot") + 288)))
    mean = F.floor(F.avg("kmh").over(per.orderBy("pos").rowsBetween(-3, 3))).cast("long")
    smooth = tripled.withColumn("mean", mean).where("pos between 0 and 287").select("edge_id", "slot", F.least("mean", "free_flow").alias("kmh"))
    before = F.lag("kmh").over(per.orderBy("slot"))
    return smooth.withColumn("before", before).where("before is null or before <> kmh").select("edge_id", "slot", "kmh")


def geojson_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, feature: a GeoJSON line per edge, for maps."""
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat")) for k in ("tail", "head"))
    both = edges.join(a, "tail").join(b, "head")
    text = F.format_string('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[%.6f,%.6f],[%.6f,%.6f]]},"properties":{"edge":%d}}', "tail_lon", "tail_lat", "head_lon", "head_lat", "edge_id")
    return both.select("edge_id", text.alias("feature"))


def svg_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, text: an SVG line per edge."""
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y")) for k in ("tail", "head"))
    return edges.join(a, "tail").join(b, "head").select("edge_id", F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"/>', "tail_x", "tail_y", "head_x", "head_y").alias("text"))


class Report:
    """Nested experiment report: values and lists of sub-reports under the current context."""

    def __init__(self, **meta):
        self.root: dict = dict(meta)
        self.stack = [self.root]

    def put(self, key: str, value) -> None:
        self.stack[-1][key] = value

    def context(self, key: str):
        report = self

        class Within:
            def __enter__(self):
                child: dict = {}
                report.stack[-1].setdefault(key, []).append(child)
                report.stack.append(child)
                return report

            def __exit__(self, *_):
                report.stack.pop()

        return Within()

    def json(self) -> str:
        return json.dumps(self.root, sort_keys=True)


def to_seconds(ttf: DataFrame) -> DataFrame:
    """edge_id, idx, dep, tt of a function in milliseconds as seconds, in floating point."""
    return ttf.select("edge_id", "idx", (F.col("dep") / 1000.0).alias("dep"), (F.col("tt") / 1000.0).alias("tt"))


def store(tables: dict[str, DataFrame], path: str) -> None:
    """A structure of several tables as one Parquet folder each: networks, hierarchies, customized functions,
    interval minima, query sets."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that `store` wrote; a table with other columns than its schema's is refused."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.parquet(f"{path}/{name}")
        want = [c.split()[0] for c in schema.split(", ")]
        if not set(want) <= set(df.columns):
            raise ValueError(f"{name} lacks columns: {sorted(set(want) - set(df.columns))}")
        out[name] = df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
    return out


#: Columns of the stored structures.
CH_TABLES = {"hierarchy": "dir string, low long, high long, weight long, middle long", "order": "node_id long, rank long"}
CCH_TABLES = {"edges": "lo long, hi long", "tree": "rank long, parent long"}
CUSTOMIZED_TABLES = {"weights": "lo long, hi long, up long, down long"}
METRIC_TABLES = {"intervals": "metric_id long, start long, end long", "minima": "metric_id long, edge_id long, lo long"}
QUERY_TABLES = {"queries": "query_id long, src long, dst long, departure long"}


def pack_profiles(profiles: DataFrame) -> DataFrame:
    """edge_id, starts, speeds: a row for each edge with the points (edge_id, start, kmh) of its speed profile in order."""
    points = F.array_sort(F.collect_list(F.struct("start", "kmh")))
    return profiles.groupBy("edge_id").agg(points.alias("p")).select("edge_id", F.col("p.start").alias("starts"), F.col("p.kmh").alias("speeds"))


def unpack_profiles(packed: DataFrame) -> DataFrame:
    """edge_id, start, kmh again."""
    return packed.select("edge_id", F.explode(F.arrays_zip("starts", "speeds")).alias("p")).select("edge_id", F.col("p.starts").alias("start"), F.col("p.speeds").alias("kmh"))


def population_cells(grid: DataFrame) -> DataFrame:
    """cell, x, y, population of grid rows (grid_x, grid_y, population); a cell's rows are added up, cells without
    people are left out."""
    cells = grid.groupBy(F.col("grid_x").alias("x"), F.col("grid_y").alias("y")).agg(F.sum("population").alias("population")).where("population > 0")
    return cells.select((F.col("x") * 100_000 + F.col("y")).alias("cell"), "x", "y", "population")


def live_times(edges: DataFrame, speeds: DataFrame) -> DataFrame:
    """edge_id, live_tt: 3600 * length div speed of edges (edge_id, dist_m) with a live speed (edge_id, kmh), else 0."""
    return edges.join(speeds.where("kmh > 0").groupBy("edge_id").agg(F.max("kmh").alias("kmh")), "edge_id", "left").select("edge_id", F.expr("coalesce(3600 * dist_m div kmh, 0)").alias("live_tt"))


def strip_constant(profiles: DataFrame, start: int, end: int) -> DataFrame:
    """edge_id, idx, kmh of profiles (edge_id, version, idx, kmh): the last version of each edge, without edges of one
    speed; of the rest the values start <= idx < end."""
    last = profiles.groupBy("edge_id").agg(F.max("version").alias("version"))
    own = profiles.join(last, ["edge_id", "version"]).where((F.col("idx") >= start) & (F.col("idx") < end))
    changing = own.groupBy("edge_id").agg(F.min("kmh").alias("a"), F.max("kmh").alias("b")).where("a <> b").select("edge_id")
    return own.join(changing, "edge_id", "left_semi").select("edge_id", "idx", "kmh")


def known_share(rows: DataFrame, id_col: str, known: DataFrame, known_col: str) -> DataFrame:
    """One row: rows, known (those whose id is among the known ones), per_cent (whole)."""
    ids = known.select(F.col(known_col).alias("k")).distinct()
    both = rows.join(ids, F.col(id_col) == F.col("k"), "left").agg(F.count(F.lit(1)).alias("rows"), F.count("k").alias("known"))
    return both.select("rows", "known", F.expr("100 * known div rows").alias("per_cent"))


def text_values(df: DataFrame, order: str, value: str) -> DataFrame:
    """idx, text: a vector's values as lines."""
    return df.select(F.col(order).alias("idx"), F.col(value).cast("string").alias("text"))


def parsed_values(lines: DataFrame, kind: str) -> DataFrame:
    """idx, value of lines (idx, text) as a type of TYPES; text that isn't such a number is an error."""
    return lines.select("idx", F.col("text").cast(TYPES[kind][1]).alias("value"))


def link_lines(edges: DataFrame, links: DataFrame) -> DataFrame:
    """line, text: tail,head,length,link,direction of edges (edge_id, tail, head, dist_m) and their links (edge_id, link_id,
    forward)."""
    both = edges.join(links, "edge_id")
    return both.select(F.col("edge_id").alias("line"), F.concat_ws(",", "tail", "head", "dist_m", "link_id", F.when(F.col("forward"), "1").otherwise("0")).alias("text"))


def csv_lines(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """line, text: a result's columns as lines of comma-separated values; null is empty."""
    return df.select(F.col(order).alias("line"), F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("text"))


#: What one unit of the networks' columns is: milliseconds in a second, metres in a kilometre, and so on.
UNITS = {"ms_per_second": 1000, "seconds_per_hour": 3600, "metres_per_kilometre": 1000, "ms_per_day": 86_400_000}


def unit_table(spark: SparkSession) -> DataFrame:
    """name, value of the unit scalars."""
    return spark.createDataFrame(sorted(UNITS.items()), "name string, value long")


def tikz_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """line, text: a TikZ path for each edge (edge_id, tail, head) between nodes (node_id, x, y)."""
    a, b = (nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}")) for end in ("tail", "head"))
    both = edges.join(a, "tail").join(b, "head")
    return both.select(F.col("edge_id").alias("line"), F.format_string("\\draw (%d,%d) -- (%d,%d);", "x_tail", "y_tail", "x_head", "y_head").alias("text"))
