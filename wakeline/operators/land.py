"""Land raster lookups: point flags, open water nearby, inland windows, land occupancy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.constants import SPAN_KM_PER_DEG
from wakeline.sources.scratch import materialize

WORD_BITS = 64
#: A raster with more cells is not put into a plan as a constant (2.5 MB of bits); see `land_tiles`.
CONSTANT_CELLS = 20_000_000


@dataclass(frozen=True)
class LandGrid:
    """A table (row, col, land) of equal cells; row 0 / col 0 start at lat_min / lon_min."""

    cells: DataFrame
    lat_min: float
    lon_min: float
    res_deg: float
    n_rows: int
    n_cols: int

    @property
    def size(self) -> int:
        return self.n_rows * self.n_cols

    def row_of(self, lat: Column) -> Column:
        return F.floor((lat - F.lit(self.lat_min)) / F.lit(self.res_deg)).cast("int")

    def col_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.lon_min)) / F.lit(self.res_deg)).cast("int")


def grid_shape(lat_min: float, lat_max: float, lon_min: float, lon_max: float, res: float) -> tuple[int, int]:
    return int((lat_max - lat_min) / res + 1e-6) + 1, int((lon_max - lon_min) / res + 1e-6) + 1


def cell_nodes(spark: SparkSession, lat_min, lat_max, lon_min, lon_max, res) -> DataFrame:
    """All cells of a box with the position of their node, generated by one range."""
    n_rows, n_cols = grid_shape(lat_min, lat_max, lon_min, lon_max, res)
    row, col = F.floor(F.col("id") / n_cols).cast("int"), (F.col("id") % n_cols).cast("int")
    return spark.range(n_rows * n_cols).select(
        row.alias("row"),
        col.alias("col"),
        (F.lit(lat_min) + row * F.lit(res)).alias("lat"),
        (F.lit(lon_min) + col * F.lit(res)).alias("lon"),
    )


def build_grid(mask: LandGrid, lat_min: float, lat_max: float, lon_min: float, lon_max: float, res: float) -> LandGrid:
    """A grid for a box and resolution, sampled from a finer mask at each node."""
    nodes = cell_nodes(mask.cells.sparkSession, lat_min, lat_max, lon_min, lon_max, res)
    cells = flag_land(nodes, mask).select("row", "col", F.col("land").cast("tinyint").alias("land"))
    n_rows, n_cols = grid_shape(lat_min, lat_max, lon_min, lon_max, res)
    return LandGrid(cells, lat_min, lon_min, res, n_rows, n_cols)


def flag_land(points: DataFrame, grid: LandGrid, lat: str = "lat", lon: str = "lon", out: str = "land") -> DataFrame:
    """Land flag of the cell of each point; outside the raster counts as water."""
    return points.withColumn(out, land_lookup(grid)(grid.row_of(F.col(lat)), grid.col_of(F.col(lon))))


def land_lookup(grid: LandGrid):
    """A function (row, col) -> land as a Column, the same for a raster of any size.

    The raster is one constant of 64-bit words, a bit per cell: its size is set by the
    box and the resolution (10 million cells take 1.25 MB), not by the data. A lookup
    takes the same time for every cell and needs neither a join nor a row per neighbour.
    Rasters of more than `CONSTANT_CELLS` cells are refused: they are read by tiles.
    """
    if grid.size > CONSTANT_CELLS:
        raise ValueError(f"A raster of {grid.size} cells is too large for a constant; use land_tiles and the functions *_by_tiles")
    per_row = -(-grid.n_cols // WORD_BITS)
    place = F.col("row") * per_row + F.floor(F.col("col") / WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(col % {WORD_BITS} as int))")
    inside = f"land = 1 AND row BETWEEN 0 AND {grid.n_rows - 1} AND col BETWEEN 0 AND {grid.n_cols - 1}"
    words = [0] * (per_row * grid.n_rows)
    for r in grid.cells.filter(inside).groupBy(place.alias("w")).agg(F.bit_or(bit).alias("bits")).collect():
        words[r["w"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one constant

    def at(row: Column, col: Column) -> Column:
        inside = (row >= 0) & (row < grid.n_rows) & (col >= 0) & (col < grid.n_cols)
        word = F.element_at(table, (row * per_row + F.floor(col / WORD_BITS) + 1).cast("int"))
        return F.when(inside, F.getbit(word, col % WORD_BITS) == 1).otherwise(F.lit(False))

    return at


def land_tiles(grid: LandGrid) -> DataFrame:
    """(tile, words): a written table with the bits of 64 by 64 cells a row; tiles without land have no row.

    For rasters of any size, such as one of the globe: no cell reaches the driver or the plan.
    """
    bit = F.expr(f"shiftleft(1L, cast(col % {WORD_BITS} as int))")
    inside = f"land = 1 AND row BETWEEN 0 AND {grid.n_rows - 1} AND col BETWEEN 0 AND {grid.n_cols - 1}"
    line = (F.col("row") % WORD_BITS).cast("int").alias("line")
    lines = grid.cells.filter(inside).groupBy(tile_of(grid, F.col("row"), F.col("col")).alias("tile"), line).agg(F.bit_or(bit).alias("bits"))
    by_line = lines.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("line", "bits"))).alias("lines"))
    every_line = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    words = F.transform(every_line, lambda i: F.coalesce(F.element_at("lines", i), F.lit(0).cast("bigint")))
    return materialize(by_line.select("tile", words.alias("words")), "land-tiles")


def tile_of(grid: LandGrid, row: Column, col: Column) -> Column:
    """Number of the tile of a cell; null outside the raster."""
    inside = (row >= 0) & (row < grid.n_rows) & (col >= 0) & (col < grid.n_cols)
    tiles_per_row = -(-grid.n_cols // WORD_BITS)
    return F.when(inside, F.floor(row / WORD_BITS) * tiles_per_row + F.floor(col / WORD_BITS))


def _bit(words: Column, row: Column, col: Column) -> Column:
    """The land bit of a cell in the words of its tile; water without a tile."""
    word = F.element_at(words, (F.pmod(row, F.lit(WORD_BITS)) + 1).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(col, F.lit(WORD_BITS))) == 1, F.lit(False))


def flag_land_by_tiles(points: DataFrame, grid: LandGrid, tiles: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "land") -> DataFrame:
    """`flag_land` by one join on the tile; AQE splits a tile that holds many of the points."""
    row, col = grid.row_of(F.col(lat)), grid.col_of(F.col(lon))
    joined = points.withColumn("_tile", tile_of(grid, row, col)).join(
        tiles.select(F.col("tile").alias("_tile"), F.col("words").alias("_words")), "_tile", "left"
    )
    return joined.withColumn(out, _bit(F.col("_words"), row, col)).drop("_tile", "_words")


def inland_fraction_by_tiles(
    windows: DataFrame, grid: LandGrid, tiles: DataFrame, *, km: float = 10.0, every: int = 6, key: str = "window_id"
) -> DataFrame:
    """`inland_fraction` with the few tiles around a window's track joined to it, once per (window, tile).

    `key` must be unique. What a window holds is set by the length of its history, not by the raster.
    """

    def tiles_near(p: Column) -> Column:
        near = neighbours(p.lat.cast("double"), p.lon.cast("double"), km)
        return F.transform(near, lambda q: tile_of(grid, grid.row_of(q.lat), grid.col_of(q.lon)))

    around = F.array_distinct(F.flatten(F.transform(_picked(every), tiles_near)))
    needs = windows.select(F.col(key).alias("_key"), F.explode(around).alias("tile")).filter(F.col("tile").isNotNull())
    held = needs.join(tiles, "tile").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("tile", "words"))).alias("_held"))
    lookup = lambda row, col: _bit(F.element_at("_held", tile_of(grid, row, col)), row, col)
    joined = windows.join(held, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("inland_fraction", _inland_share(grid, lookup, km, every)).drop("_key", "_held")


def neighbours(lat: Column, lon: Column, km: float) -> Column:
    """The point and, for km > 0, eight points about `km` away."""
    here = F.struct(lat.alias("lat"), lon.alias("lon"))
    if km <= 0:
        return F.array(here)
    clipped = F.least(F.greatest(lat, F.lit(-60.0)), F.lit(60.0))
    dlat = F.lit(km / SPAN_KM_PER_DEG)
    dlon = F.lit(km) / (F.lit(SPAN_KM_PER_DEG) * F.cos(F.radians(clipped)))
    around = [
        F.struct((lat + dlat * a).alias("lat"), (lon + dlon * b).alias("lon"))
        for a in (-1, 0, 1)
        for b in (-1, 0, 1)
        if (a, b) != (0, 0)
    ]
    return F.array(here, *around)


def flag_open_water(points: DataFrame, grid: LandGrid, km: float = 10.0, out: str = "open_water") -> DataFrame:
    """Whether a point or a neighbour is water, within the row of the point."""
    return points.withColumn(out, open_water(F.col("lat"), F.col("lon"), grid, land_lookup(grid), km))


def open_water(lat: Column, lon: Column, grid: LandGrid, lookup, km: float = 10.0) -> Column:
    """The same test as one expression."""
    return F.exists(
        neighbours(lat, lon, km), lambda p: ~lookup(grid.row_of(p.lat), grid.col_of(p.lon))
    )


def inland_fraction(windows: DataFrame, grid: LandGrid, *, km: float = 10.0, every: int = 6) -> DataFrame:
    """Share of every `every`-th history point that has no open water within `km`; null for an empty history."""
    return windows.withColumn("inland_fraction", _inland_share(grid, land_lookup(grid), km, every))


def _picked(every: int) -> Column:
    return F.filter("hist", lambda p, i: i % max(1, every) == 0)


def _inland_share(grid: LandGrid, lookup, km: float, every: int) -> Column:
    inland = F.transform(
        _picked(every),
        lambda p: F.when(open_water(p.lat.cast("double"), p.lon.cast("double"), grid, lookup, km), 0.0).otherwise(1.0),
    )
    return F.aggregate(inland, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(inland), F.lit(0))


def filter_inland(windows: DataFrame, grid: LandGrid, *, km: float = 10.0, every: int = 6, max_fraction: float = 0.5) -> DataFrame:
    """Keep windows whose inland share is at most `max_fraction`; an empty history has no inland point and is kept."""
    return inland_fraction(windows, grid, km=km, every=every).filter(
        F.coalesce("inland_fraction", F.lit(0.0)) <= max_fraction
    ).drop("inland_fraction")


def land_occupancy(points: DataFrame, grid: LandGrid, lat: str = "lat", lon: str = "lon", out: str = "occupancy") -> DataFrame:
    """Bilinear raster value at each point, cells taken as nodes; 0 outside the nodes."""
    y = (F.col(lat) - F.lit(grid.lat_min)) / F.lit(grid.res_deg)
    x = (F.col(lon) - F.lit(grid.lon_min)) / F.lit(grid.res_deg)
    inside = (y >= 0) & (y <= grid.n_rows - 1) & (x >= 0) & (x <= grid.n_cols - 1)
    pts = (
        points.withColumn("_y", y)
        .withColumn("_x", x)
        .withColumn("_r", F.floor("_y").cast("int"))
        .withColumn("_c", F.floor("_x").cast("int"))
    )
    wy, wx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    corners = [(dr, dc, a * b) for dr, a in ((0, 1 - wy), (1, wy)) for dc, b in ((0, 1 - wx), (1, wx))]
    lookup = land_lookup(grid)
    value = F.lit(0.0)
    for dr, dc, weight in corners:
        value = value + lookup(F.col("_r") + dr, F.col("_c") + dc).cast("double") * weight
    return pts.withColumn(out, F.when(inside, value).otherwise(F.lit(0.0))).select(*points.columns, out)


def land_penalty(points: DataFrame, grid: LandGrid, by: list[str], weight: float = 0.1, lat: str = "pred_lat", lon: str = "pred_lon") -> DataFrame:
    """Mean land occupancy of predicted points times a weight, per group."""
    return land_occupancy(points, grid, lat, lon).groupBy(*by).agg(
        (F.avg("occupancy") * F.lit(weight)).alias("land_penalty")
    )
