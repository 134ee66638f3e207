"""Registered queries of the volume operators and their DuckDB equivalents.

Each row of ``embeddings`` is read as a 4 x 4 x 4 volume, axis 0 fastest, spacing (1, 1, 2.5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxframe.functions import diagnostics, geometry
from voxframe.operators import augment, grid, intensity, sampling, subjects
from voxframe.plans.pipeline import TransformPipeline
from voxframe.sources import files as volume_files, nifti

SHAPE, SPACING, SEED = [4, 4, 4], [1.0, 1.0, 2.5], 42
SHIFTED = [[0.8, 0.1, 0.0, 0.3], [0.0, 0.9, 0.0, 0.2], [0.0, 0.0, 1.0, -0.5]]


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, shape and data of every row of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.array(*map(F.lit, SHAPE)).alias("shape"), F.array(*map(F.lit, SPACING)).alias("spacing"), F.col("embedding").cast("array<double>").alias("data"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, clamp and resample all volumes."""
    return queries()["pipeline_znorm_clamp_resample"](spark, sf_dir)


def rounded(value: Column | str) -> Column:
    """Four decimals by operations that both engines do alike on doubles."""
    return F.floor((F.col(value) if isinstance(value, str) else value) * 10000 + 0.5) / 10000


def sql_rounded(value: str) -> str:
    return f"floor(({value})::DOUBLE * 10000 + 0.5) / 10000"


def flat(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("data").alias("i", "v")).select("vec_id", "i", rounded("v").alias("v"))


QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOXELS = "WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1)::INT - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT *, i % 4 AS x, (i // 4) % 4 AS y, i // 16 AS z FROM v) "
STATS = VOXELS + ", s AS (SELECT vec_id, avg(v) AS m, CASE WHEN avg(v * v) - avg(v) * avg(v) > 0 THEN sqrt(avg(v * v) - avg(v) * avg(v)) ELSE 1 END AS sd, min(v) AS lo, max(v) AS hi, count(*) AS n FROM v GROUP BY vec_id) "
FROM_STATS = " FROM c JOIN s USING (vec_id)"


def add(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def voxelwise(name: str, query: Callable[[DataFrame], DataFrame], value: str) -> None:
    add(name, lambda df: flat(query(df)), f"{STATS} SELECT vec_id, i, {sql_rounded(value)} AS v{FROM_STATS}")


def remapped(name: str, query: Callable[[DataFrame], DataFrame], size: tuple[int, int, int], value: str) -> None:
    """``value`` is SQL over e (the 64 values, first at 1) and the output place x, y, z."""
    nx, ny, nz = size
    sql = f"SELECT vec_id, o::INT AS i, {sql_rounded(value)} AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, o, (o % {nx})::INT AS x, ((o // {nx}) % {ny})::INT AS y, (o // {nx * ny})::INT AS z FROM embeddings, range({nx * ny * nz}) t(o))"
    add(name, lambda df: flat(query(df)), sql)


def at(x: str, y: str, z: str) -> str:
    return f"e[(1 + ({x}) + 4 * ({y}) + 16 * ({z}))::INT]"


def inside(x: str, y: str, z: str) -> str:
    return f"CASE WHEN ({x}) BETWEEN 0 AND 3 AND ({y}) BETWEEN 0 AND 3 AND ({z}) BETWEEN 0 AND 3 THEN {at(x, y, z)} ELSE 0.0 END"


def blended(px: str, py: str, pz: str) -> str:
    """Trilinear mean around a fractional place."""
    out = []
    for cx in (0, 1):
        for cy in (0, 1):
            for cz in (0, 1):
                w = " * ".join(f"({p} - floor({p}))" if c else f"(1 - ({p} - floor({p})))" for p, c in ((px, cx), (py, cy), (pz, cz)))
                out.append(w + " * " + at(*[f"least(floor({p}) + {c}, 3)" for p, c in ((px, cx), (py, cy), (pz, cz))]))
    return "(" + " + ".join(out) + ")"


def u(*keys: str) -> str:
    """The hashed uniform of quoted or column keys."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


SEED_KEY = f"'{SEED}'"

add("volume_info", lambda df: df.select("vec_id", F.size("data").alias("n"), (F.lit(SPACING[0] * SPACING[1] * SPACING[2]) * F.size("data")).alias("volume")), "SELECT vec_id, len(embedding)::INT AS n, 2.5::DOUBLE * len(embedding) AS volume FROM embeddings")
add("volume_stats", lambda df: intensity.statistics(df).select("vec_id", "n", *[F.round(c, 4).alias(c) for c in ("v_min", "v_max", "v_mean", "v_std")]), f"{STATS} SELECT vec_id, n, round(lo, 4) AS v_min, round(hi, 4) AS v_max, round(m, 4) AS v_mean, round(sd, 4) AS v_std FROM s")
voxelwise("scale_slope_inter", lambda df: intensity.linear(df, 2.0, 10.0), "v * 2 + 10")
add("cast_uint8", lambda df: df.transform(lambda d: intensity.to_integer(intensity.linear(d, 400.0, 100.0), 0, 255)).select("vec_id", F.posexplode("data").alias("i", "v")), VOXELS + "SELECT vec_id, i, least(greatest(round(v * 400 + 100), 0), 255)::BIGINT AS v FROM c")
add("cast_int16", lambda df: intensity.to_integer(intensity.linear(df, 1e5, 0.0), -32768, 32767).select("vec_id", F.posexplode("data").alias("i", "v")), VOXELS + "SELECT vec_id, i, least(greatest(round(v * 100000.0::DOUBLE), -32768), 32767)::BIGINT AS v FROM c")
voxelwise("z_normalize", intensity.z_normalize, "(v - m) / sd")
voxelwise("rescale", lambda df: intensity.rescale(df, -1.0, 1.0), "(v - lo) / (hi - lo) * 2 - 1")
voxelwise("rescale_constant", lambda df: intensity.rescale(intensity.clamp(df, 5.0, 5.0), 0.25, 1.0), "0.25::DOUBLE")
voxelwise("clamp", lambda df: intensity.clamp(df, -0.1, 0.1), "least(greatest(v, -0.1::DOUBLE), 0.1::DOUBLE)")
voxelwise("linear", lambda df: intensity.linear(df, -3.0, 0.5), "v * -3 + 0.5::DOUBLE")
voxelwise("pipeline_fused_intensity", lambda df: TransformPipeline().z_normalize().clamp(-2.0, 2.0).linear(0.25, 0.5).apply(df), "least(greatest((v - m) / sd, -2), 2) * 0.25::DOUBLE + 0.5::DOUBLE")
remapped("flip_x", lambda df: grid.flip(df, [0]), (4, 4, 4), at("3 - x", "y", "z"))
remapped("flip_xyz", lambda df: grid.flip(df, [0, 1, 2]), (4, 4, 4), at("3 - x", "3 - y", "3 - z"))
remapped("rotate90_k1", lambda df: grid.rotate_90(df, 1), (4, 4, 4), at("3 - y", "x", "z"))
remapped("rotate90_k2", lambda df: grid.rotate_90(df, 2), (4, 4, 4), at("3 - x", "3 - y", "z"))
remapped("reorient_lps", lambda df: grid.reorient(df, "LPS", "RAS"), (4, 4, 4), at("3 - x", "3 - y", "z"))
remapped("reorient_permuted", lambda df: grid.reorient(df, "SLA", "RAS"), (4, 4, 4), at("3 - y", "z", "x"))
remapped("crop_box", lambda df: grid.crop(df, [1, 0, 2], [3, 3, 9]), (2, 3, 2), at("x + 1", "y", "z + 2"))
remapped("center_crop", lambda df: grid.center_crop(df, [2, 3, 2]), (2, 3, 2), at("x + 1", "y", "z + 1"))
remapped("crop_or_pad_crop", lambda df: grid.crop_or_pad(df, [2, 2, 3]), (2, 2, 3), at("x + 1", "y + 1", "z"))
remapped("crop_or_pad_pad", lambda df: grid.crop_or_pad(df, [6, 5, 4]), (6, 5, 4), inside("x - 1", "y", "z"))
remapped("crop_or_pad_mixed", lambda df: grid.crop_or_pad(df, [2, 7, 4]), (2, 7, 4), inside("x + 1", "y - 1", "z"))
remapped("resample_shape_up", lambda df: grid.resample_trilinear(df, [6, 5, 7]), (6, 5, 7), blended("(x * 3 / 5.0::DOUBLE)", "(y * 3 / 4.0::DOUBLE)", "(z * 3 / 6.0::DOUBLE)"))
remapped("resample_shape_down", lambda df: grid.resample_trilinear(df, [3, 2, 1]), (3, 2, 1), blended("(x * 3 / 2.0::DOUBLE)", "(y * 3 / 1.0::DOUBLE)", "(z * 0.0::DOUBLE)"))
remapped("resample_nearest", lambda df: grid.resample_nearest(df, [6, 3, 5]), (6, 3, 5), at("least(floor((x + 0.5) * 4 / 6), 3)", "least(floor((y + 0.5) * 4 / 3), 3)", "least(floor((z + 0.5) * 4 / 5), 3)"))
remapped("resample_spacing", lambda df: TransformPipeline().resample_to_spacing([1.0, 2.0, 1.0]).apply(df), (4, 2, 10), blended("(x * 3 / 3.0::DOUBLE)", "(y * 3 / 1.0::DOUBLE)", "(z * 3 / 9.0::DOUBLE)"))
PLACE = [f"({' + '.join(f'{a} * {m}::DOUBLE' for a, m in zip('xyz', row, strict=False))} + {row[3]}::DOUBLE)" for row in SHIFTED]
remapped("apply_affine_trilinear", lambda df: grid.apply_affine(df, SHIFTED), (4, 4, 4), "CASE WHEN " + " AND ".join(f"{p} >= 0 AND {p} <= 3" for p in PLACE) + f" THEN {blended(*PLACE)} ELSE 0.0 END")
add(
    "pipeline_znorm_clamp_resample",
    lambda df: flat(TransformPipeline().z_normalize().clamp(-2.0, 2.0).resample_to_shape([6, 6, 6]).apply(df)),
    f"{STATS}, n AS (SELECT vec_id, list(least(greatest((v - m) / sd, -2), 2) ORDER BY i) AS e{FROM_STATS} GROUP BY vec_id) SELECT vec_id, o::INT AS i, {sql_rounded(blended('(x * 3 / 5.0::DOUBLE)', '(y * 3 / 5.0::DOUBLE)', '(z * 3 / 5.0::DOUBLE)'))} AS v FROM (SELECT vec_id, e, o, o % 6 AS x, (o // 6) % 6 AS y, o // 36 AS z FROM n, range(216) t(o))",
)
add(
    "foreground_bbox",
    lambda df: sampling.foreground_box(df, 0.2, 1, 0.02),
    VOXELS + "SELECT vec_id, count(*) AS n, greatest(min(x) - 1, 0) AS x0, greatest(min(y) - 1, 0) AS y0, greatest(min(z) - 1, 0) AS z0, least(max(x) + 2, 4) AS x1, least(max(y) + 2, 4) AS y1, least(max(z) + 2, 4) AS z1 FROM c WHERE v > 0.2::DOUBLE GROUP BY vec_id HAVING count(*) >= 1.28",
)
add("label_voxel_counts", lambda df: df.select("vec_id", F.size(F.filter("data", lambda v: v > 0.1)).cast("long").alias("positive"), F.size(F.filter("data", lambda v: v <= 0.1)).cast("long").alias("negative")), VOXELS + "SELECT vec_id, count(*) FILTER (v > 0.1::DOUBLE) AS positive, count(*) FILTER (v <= 0.1::DOUBLE) AS negative FROM c GROUP BY vec_id")
DRAWN = f"{u(SEED_KEY, chr(39) + 'label' + chr(39), 'vec_id', 'k')}"
CENTRED = ", ".join(f"greatest(0, {c} - 1)::INT AS {c}0, least(greatest(0, {c} - 1) + {s}, 4)::INT AS {c}1" for c, s in zip("xyz", (2, 3, 2), strict=True))
add(
    "label_aware_regions",
    lambda df: sampling.label_aware_regions(df, [2, 3, 2], 5, SEED, ratio=1.5, background=0.1),
    f"WITH k AS (SELECT vec_id, list_filter(range(64), lambda i: embedding[i + 1]::DOUBLE > 0.1::DOUBLE) AS p, list_filter(range(64), lambda i: embedding[i + 1]::DOUBLE <= 0.1::DOUBLE) AS q FROM embeddings), d AS (SELECT vec_id, k, k < 3 AS positive, CASE WHEN k < 3 THEN p ELSE q END AS own, {DRAWN} AS u FROM k, range(5) t(k)), c AS (SELECT *, own[1 + floor(u * len(own))::INT] AS i FROM d) SELECT vec_id, k::INT AS k, positive, {CENTRED} FROM (SELECT *, i % 4 AS x, (i // 4) % 4 AS y, i // 16 AS z FROM c)",
)
add(
    "label_aware_fallback",
    lambda df: sampling.label_aware_regions(df, [2, 3, 4], 3, SEED, background=9.0),
    "SELECT vec_id, k::INT AS k, false AS positive, x0, y0, z0, x0 + 2 AS x1, y0 + 3 AS y1, z0 + 4 AS z1 FROM (SELECT vec_id, k, " + ", ".join(f"floor({u(SEED_KEY, chr(39) + 'box' + chr(39), 'vec_id', 'k', chr(39) + str(a) + chr(39))} * {4 - s + 1})::INT AS {c}0" for a, (c, s) in enumerate(zip("xyz", (2, 3, 4), strict=True))) + " FROM embeddings, range(3) t(k))",
)
add(
    "random_regions",
    lambda df: sampling.random_starts(df, [2, 3, 4], 4, SEED),
    "SELECT vec_id, k::INT AS k, " + ", ".join(f"floor({u(SEED_KEY, chr(39) + 'box' + chr(39), 'vec_id', 'k', chr(39) + str(a) + chr(39))} * {4 - s + 1})::INT AS {c}0" for a, (c, s) in enumerate(zip("xyz", (2, 3, 4), strict=True))) + " FROM embeddings, range(4) t(k)",
)
add("grid_patches", lambda df: sampling.grid_starts(df, [2, 3, 2], 1), "SELECT vec_id, x0::INT AS x0, y0::INT AS y0, z0::INT AS z0 FROM embeddings, range(0, 3, 1) a(x0), range(0, 2, 2) b(y0), range(0, 3, 1) d(z0)")
add("patch_means", lambda df: sampling.patch_means(df, [2, 2, 2]).withColumn("mean", F.round("mean", 4)), VOXELS + "SELECT vec_id, (x // 2 * 2)::INT AS x0, (y // 2 * 2)::INT AS y0, (z // 2 * 2)::INT AS z0, round(avg(v), 4) AS mean FROM c GROUP BY ALL")
TURN = {k: u(SEED_KEY, "'flip'", "vec_id", f"'{k}'") + " < 0.5" for k in range(3)}
remapped("random_flip", lambda df: augment.random_flip(df, SEED), (4, 4, 4), at(*[f"CASE WHEN {TURN[k]} THEN 3 - {c} ELSE {c} END" for k, c in enumerate("xyz")]))
NOISE = f"sqrt(-2 * ln(greatest({u(SEED_KEY, chr(39) + 'noise' + chr(39), 'vec_id', 'i', chr(39) + '1' + chr(39))}, 1e-10))) * cos({u(SEED_KEY, chr(39) + 'noise' + chr(39), 'vec_id', 'i', chr(39) + '2' + chr(39))} * 2 * pi())"
voxelwise("gaussian_noise", lambda df: augment.gaussian_noise(df, SEED), f"v + {NOISE} * 0.1::DOUBLE")
SCALE, SHIFT = (f"({u(SEED_KEY, chr(39) + k + chr(39), 'vec_id')} * 0.2::DOUBLE - 0.1::DOUBLE)" for k in ("scale", "shift"))
voxelwise("intensity_scale", lambda df: augment.intensity_scale(df, SEED), f"v * (1 + {SCALE})")
voxelwise("intensity_shift", lambda df: augment.intensity_shift(df, SEED), f"v + {SHIFT}")
voxelwise("random_gamma", lambda df: augment.random_gamma(df, SEED), f"pow(greatest(v, 0), {u(SEED_KEY, chr(39) + 'gamma' + chr(39), 'vec_id')} * 0.8::DOUBLE + 0.7::DOUBLE)")
remapped("random_augment", lambda df: augment.random_augment(df, SEED), (4, 4, 4), f"{at(*[f'CASE WHEN {TURN[k]} THEN 3 - {c} ELSE {c} END' for k, c in enumerate('xyz')])} * (1 + {SCALE}) + {SHIFT} + {NOISE.replace(', i, ', ', o, ')} * 0.05::DOUBLE")


def epoch_shuffle(df: DataFrame) -> DataFrame:
    return sampling.epoch(df, SEED, 0)


PLACED = f"SELECT vec_id, row_number() OVER (ORDER BY {u(SEED_KEY, chr(39) + 'epoch' + chr(39), chr(39) + '0' + chr(39), 'vec_id')}, vec_id) - 1 AS place FROM embeddings"
add("epoch_shuffle", epoch_shuffle, PLACED)
add("batches", lambda df: sampling.batches(epoch_shuffle(df), 32), f"SELECT vec_id, place // 32 AS batch, place % 32 AS slot FROM ({PLACED})")


def pairs(df: DataFrame) -> DataFrame:
    """Two volumes of one subject: an image and its label, by subject = vec_id div 2."""
    keyed = df.withColumn("subject", F.floor(F.col("vec_id") / 2))
    image = keyed.where(F.col("vec_id") % 2 == 0).select("subject", F.col("data").alias("image"))
    label = keyed.where(F.col("vec_id") % 2 == 1).select("subject", F.col("data").alias("label"))
    return image.join(label, "subject").select("subject", F.posexplode(F.arrays_zip("image", "label")).alias("i", "p")).select("subject", "i", F.round("p.image", 4).alias("image"), (F.col("p.label") > 0.1).alias("label"))


add("image_label_pair", pairs, VOXELS + "SELECT a.vec_id // 2 AS subject, a.i, round(a.v, 4) AS image, b.v > 0.1::DOUBLE AS label FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0")
add(
    "affine_point",
    lambda df: df.select("vec_id", *[rounded(p).alias(c) for c, p in zip("xyz", geometry.transform_point(geometry.rows_of(SHIFTED), [F.get("data", k) for k in range(3)]), strict=True)]),
    "SELECT vec_id, " + ", ".join(sql_rounded(f"embedding[1]::DOUBLE * {r[0]}::DOUBLE + embedding[2]::DOUBLE * {r[1]}::DOUBLE + embedding[3]::DOUBLE * {r[2]}::DOUBLE + {r[3]}::DOUBLE") + f" AS {c}" for c, r in zip("xyz", SHIFTED, strict=True)) + " FROM embeddings",
)
IDENTITY = VOXELS + "SELECT vec_id, i, v FROM c"


def roundtrip(df: DataFrame, **how: object) -> DataFrame:
    """Volumes written as NIfTI bytes and parsed again."""
    files = nifti.encoded(df, **how).select(F.col("vec_id").cast("string").alias("path"), "content")
    return nifti.decoded(files).select(F.col("path").cast("long").alias("vec_id"), F.posexplode("data").alias("i", "v"))


add("nifti_roundtrip", lambda df: roundtrip(df, version=2), IDENTITY)
add("mgzip_roundtrip", lambda df: roundtrip(df, compressed=True), IDENTITY)


def narrow(bits: int, least: int) -> str:
    """The nearest float with so many bits of mantissa, even of two as near."""
    unit = f"pow(2::DOUBLE, greatest(floor(log2(abs(v))), {least}) - {bits})"
    return VOXELS + f"SELECT vec_id, i, CASE WHEN v = 0 THEN 0 ELSE round_even(v / {unit}, 0) * {unit} END::DOUBLE AS v FROM c"


add("cast_float16", lambda df: roundtrip(df, dtype="float16"), narrow(10, -14))
add("cast_bfloat16", lambda df: roundtrip(df, dtype="bfloat16"), narrow(7, -126))
add("with_dtype_float16", lambda df: intensity.with_dtype(df, "float16").select("vec_id", F.posexplode("data").alias("i", "v")), narrow(10, -14))
add("with_dtype_int8", lambda df: intensity.with_dtype(intensity.linear(df, 400.0, 0.0), "int8").select("vec_id", F.posexplode("data").alias("i", "v")), VOXELS + "SELECT vec_id, i, least(greatest(round(v * 400), -128), 127)::DOUBLE AS v FROM c")
add("with_dtype_uint16", lambda df: intensity.with_dtype(intensity.linear(df, 2e5, 0.0), "uint16").select("vec_id", F.posexplode("data").alias("i", "v")), VOXELS + "SELECT vec_id, i, least(greatest(round(v * 200000), 0), 65535)::DOUBLE AS v FROM c")
add(
    "header_parse",
    lambda df: nifti.decoded(nifti.encoded(df).select(F.col("vec_id").cast("string").alias("path"), "content")).select(F.col("path").cast("long").alias("vec_id"), "version", "dtype", F.size("shape").alias("ndim"), F.aggregate("shape", F.lit(1), lambda a, d: a * d).alias("n")),
    "SELECT vec_id, 1::INT AS version, 'float32' AS dtype, 3::INT AS ndim, 64::INT AS n FROM embeddings",
)
add("load_cropped", lambda df: nifti.decoded(nifti.encoded(df).select(F.col("vec_id").cast("string").alias("path"), "content"), ([1, 0, 2], [3, 3, 4])).select(F.col("path").cast("long").alias("vec_id"), F.posexplode("data").alias("i", "v")), "SELECT vec_id, o::INT AS i, embedding[(2 + o % 2 + 4 * ((o // 2) % 3) + 16 * (2 + o // 6))::INT]::DOUBLE AS v FROM embeddings, range(12) t(o)")


TURNS = f"floor({u(SEED_KEY, chr(39) + 'rotate' + chr(39), 'vec_id')} * 4)"
remapped("random_rotate90", lambda df: augment.random_rotate_90(df, SEED), (4, 4, 4), f"CASE {TURNS} WHEN 0 THEN {at('x', 'y', 'z')} WHEN 1 THEN {at('3 - y', 'x', 'z')} WHEN 2 THEN {at('3 - x', '3 - y', 'z')} ELSE {at('y', '3 - x', 'z')} END")
add("num_voxels", lambda df: df.select("vec_id", F.aggregate("shape", F.lit(1), lambda a, d: a * d).alias("n")), "SELECT vec_id, 64::INT AS n FROM embeddings")
#: The affines of four orientations: RAS, LPS, LAS and one with its axes permuted.
AFFINES = [[[1.0, 0, 0], [0, 1.0, 0], [0, 0, 2.5]], [[-1.0, 0, 0], [0, -1.0, 0], [0, 0, 2.5]], [[-1.0, 0, 0], [0, 1.0, 0], [0, 0, 2.5]], [[0, -1.0, 0], [0, 0, 2.5], [1.0, 0, 0]]]


def affine_by_label() -> Column:
    options = F.array(*[geometry.matrix_of([[F.lit(float(x)) for x in [*row, 0.0]] for row in m]) for m in AFFINES])
    return F.get(options, F.col("label") % 4)


add("orientation_code", lambda df: df.select("vec_id", geometry.orientation_code(affine_by_label()).alias("code")), "SELECT vec_id, CASE label % 4 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'LAS' ELSE 'SLA' END AS code FROM embeddings")


ORIGIN = [10.0, 20.0, 30.0]


def placed(df: DataFrame) -> DataFrame:
    """Volumes with the affine of their label's orientation and one origin."""
    return df.withColumn("affine", F.get(F.array(*[F.array(*[F.lit(float(x)) for row, o in zip(m, ORIGIN, strict=True) for x in (*row, o)]) for m in AFFINES]), F.col("label") % 4))


def located(df: DataFrame) -> DataFrame:
    """Shape, spacing and affine of each volume."""
    cells = [F.get("affine", k) + 0.0 for k in range(12)]
    return df.select("vec_id", *[F.get("shape", k).alias(f"n{k}") for k in range(3)], *[F.get("spacing", k).alias(f"s{k}") for k in range(3)], *[c.alias(f"m{k // 4}{k % 4}") for k, c in enumerate(cells)])


def sql_located(size: tuple[str, str, str], spacing: tuple[str, str, str], cells: list[str]) -> str:
    """``cells``: twelve expressions over the source affine m (first at 1)."""
    options = " ".join(f"WHEN {k} THEN [{', '.join(str(float(x)) for row, o in zip(m, ORIGIN, strict=True) for x in (*row, o))}]" for k, m in enumerate(AFFINES))
    return f"SELECT vec_id, {', '.join(f'{n}::INT AS n{k}' for k, n in enumerate(size))}, {', '.join(f'({x})::DOUBLE AS s{k}' for k, x in enumerate(spacing))}, {', '.join(f'({c})::DOUBLE + 0 AS m{k // 4}{k % 4}' for k, c in enumerate(cells))} FROM (SELECT vec_id, label % 4 AS o, CASE label % 4 {options} END::DOUBLE[] AS m FROM embeddings)"


def shifted_cells(start: tuple[int, int, int]) -> list[str]:
    return [f"m[{4 * r + c + 1}]" if c < 3 else f"m[{4 * r + 4}] + " + " + ".join(f"m[{4 * r + k + 1}] * {s}" for k, s in enumerate(start)) for r in range(3) for c in range(4)]


SAME = tuple(map(str, SPACING))
add("crop_affine", lambda df: located(grid.crop(placed(df), [1, 0, 2], [3, 3, 9])), sql_located(("2", "3", "2"), SAME, shifted_cells((1, 0, 2))))
add("crop_or_pad_affine", lambda df: located(grid.crop_or_pad(placed(df), [2, 7, 3])), sql_located(("2", "7", "3"), SAME, shifted_cells((1, -1, 0))))
add("resample_affine", lambda df: located(grid.resample_trilinear(placed(df), [8, 2, 5])), sql_located(("8", "2", "5"), ("0.5", "2", "2.0"), [f"m[{k + 1}] * {(0.5, 2.0, 0.8, 1.0)[k % 4]}::DOUBLE" for k in range(12)]))
add("resample_spacing_affine", lambda df: located(grid.resample_to_spacing(placed(df), [2.0, 0.5, 2.0])), sql_located(("2", "8", "5"), ("2", "0.5", "2"), [f"m[{k + 1}] * {(2.0, 0.5, 0.8, 1.0)[k % 4]}::DOUBLE" for k in range(12)]))
#: The four affines turned to LPS: columns are permuted and negated, and the origin moves three voxels along each reversed axis.
TURNED = [[-1, 0, 0, 13, 0, -1, 0, 23, 0, 0, 2.5, 30], [-1, 0, 0, 10, 0, -1, 0, 20, 0, 0, 2.5, 30], [-1, 0, 0, 10, 0, -1, 0, 23, 0, 0, 2.5, 30], [-1, 0, 0, 10, 0, -2.5, 0, 27.5, 0, 0, 1, 30]]
add("reorient_affine", lambda df: located(grid.reorient(placed(df), "LPS")), sql_located(("4", "4", "4"), ("1", "CASE WHEN o = 3 THEN 2.5 ELSE 1 END", "CASE WHEN o = 3 THEN 1 ELSE 2.5 END"), [f"CASE o {' '.join(f'WHEN {j} THEN {t[k]}' for j, t in enumerate(TURNED))} END" for k in range(12)]))
LPS = [at("3 - x", "3 - y", "z"), at("x", "y", "z"), at("x", "3 - y", "z"), at("z", "x", "3 - y")]
remapped("reorient_from_affine", lambda df: grid.reorient(placed(df), "LPS"), (4, 4, 4), "CASE label % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(LPS)) + " END")
NEAREST = [f"(round({p}))::INT" for p in PLACE]
remapped("apply_affine_nearest", lambda df: grid.apply_affine(df, SHIFTED, "nn"), (4, 4, 4), inside(*NEAREST))
add("spacing_from_affine", lambda df: placed(df).select("vec_id", geometry.spacing_of(F.array(*[F.slice("affine", 4 * r + 1, 4) for r in range(3)])).alias("s")).select("vec_id", *[F.get("s", k).alias(f"s{k}") for k in range(3)]), "SELECT vec_id, 1::DOUBLE AS s0, 1::DOUBLE AS s1, 2.5::DOUBLE AS s2 FROM embeddings")


def composed(df: DataFrame) -> DataFrame:
    """Scaled, moved and flipped: the three affines as one, applied to a point."""
    first = geometry.then(geometry.then(geometry.scale([2.0, 3.0, 0.5]), geometry.translate([1.0, F.get("data", 3), -2.0])), geometry.flip_axes([0, 2], [4, 4, 4]))
    return df.select("vec_id", first.alias("m"), "data").select("vec_id", *[rounded(p).alias(c) for c, p in zip("xyz", geometry.transform_point(F.col("m"), [F.get("data", k) for k in range(3)]), strict=True)])


add("affine_then", composed, "SELECT vec_id, " + ", ".join(sql_rounded(x) + f" AS {c}" for c, x in (("x", "3 - (e[1] * 2 + 1)"), ("y", "e[2] * 3 + e[4]"), ("z", "3 - (e[3] * 0.5::DOUBLE - 2)"))) + " FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
add("orientation_affine", lambda df: df.select("vec_id", geometry.of_code(F.get(F.array(*map(F.lit, ["ras", "LPS", "LAS", "SLX"])), F.col("label") % 4), F.array(*map(F.lit, SPACING))).alias("m")).select("vec_id", geometry.is_code(geometry.orientation_code(F.col("m"))).alias("known"), geometry.orientation_code(F.col("m")).alias("code")).where("known"), "SELECT vec_id, true AS known, CASE label % 4 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'LAS' END AS code FROM embeddings WHERE label % 4 < 3")


def patch_voxels(df: DataFrame, **how: object) -> DataFrame:
    return sampling.patches(df, [2, 4, 2], **how).select("vec_id", "k", "x0", "y0", "z0", F.posexplode("data").alias("i", "v")).withColumn("v", rounded("v"))


PATCH = f"SELECT vec_id, k::INT AS k, x0::INT AS x0, y0::INT AS y0, z0::INT AS z0, i::INT AS i, {sql_rounded(at('x0 + i % 2', 'y0 + (i // 2) % 4', 'z0 + i // 8'))} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, x // 2 + 2 * (z // 2) AS k, x AS x0, 0 AS y0, z AS z0 FROM embeddings, range(0, 3, 2) a(x), range(0, 3, 2) b(z)), range(16) t(i)"
add("patch_voxels", patch_voxels, PATCH)
add("patch_voxels_exact_n", lambda df: patch_voxels(df, count=3), PATCH + " WHERE k < 3")
def own_affine() -> Column:
    """Near the identity, sheared by the volume's first voxels."""
    e = [F.get("data", k) for k in range(9)]
    one, none = F.lit(1.0), F.lit(0.0)
    return geometry.matrix_of([[one, e[0], e[1], e[2]], [none, one * 2, e[3], e[4]], [e[5], none, one, e[6]]])


def inverted(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", geometry.inverse(own_affine()).alias("m"))
    return rows.select("vec_id", *[F.round(geometry.cell(F.col("m"), r, c), 4).alias(f"m{r}{c}") for r in range(3) for c in range(4)])


#: Rows of the inverse of ((1, a, b), (0, 2, c), (d, 0, 1)), times its determinant.
COFACTORS = [["2", "-a", "a * c - 2 * b"], ["c * d", "1 - b * d", "-c"], ["-2 * d", "a * d", "2"]]
SHIFTS = ["p", "q", "r"]
add(
    "affine_inverse",
    inverted,
    "WITH k AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS p, embedding[4]::DOUBLE AS c, embedding[5]::DOUBLE AS q, embedding[6]::DOUBLE AS d, embedding[7]::DOUBLE AS r FROM embeddings), t AS (SELECT *, 2 + a * c * d - 2 * b * d AS det FROM k) SELECT vec_id, "
    + ", ".join(f"round(({x}) / det, 4) AS m{i}{j}" for i, row in enumerate(COFACTORS) for j, x in enumerate(row))
    + ", " + ", ".join(f"round(-({' + '.join(f'({x}) * {s}' for x, s in zip(row, SHIFTS, strict=True))}) / det, 4) AS m{i}3" for i, row in enumerate(COFACTORS))
    + " FROM t",
)


def quaternions(df: DataFrame) -> DataFrame:
    e = [F.get("data", k) for k in range(7)]
    m = geometry.from_quaternion(e[0], e[1], e[2], e[3:6], [F.lit(s) for s in SPACING], e[6])
    return df.select("vec_id", m.alias("m")).select("vec_id", *[F.round(geometry.cell(F.col("m"), r, c), 4).alias(f"m{r}{c}") for r in range(3) for c in range(4)])


TURN_ROWS = [["a*a + b*b - c*c - d*d", "2 * (b*c - a*d)", "2 * (b*d + a*c)"], ["2 * (b*c + a*d)", "a*a + c*c - b*b - d*d", "2 * (c*d - a*b)"], ["2 * (b*d - a*c)", "2 * (c*d + a*b)", "a*a + d*d - b*b - c*c"]]
add(
    "qform_affine",
    quaternions,
    "WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS e, embedding[1]::DOUBLE AS b, embedding[2]::DOUBLE AS c, embedding[3]::DOUBLE AS d FROM embeddings), t AS (SELECT *, sqrt(greatest(0, 1 - b*b - c*c - d*d)) AS a FROM k) SELECT vec_id, "
    + ", ".join(f"round(({x}) * {('1.0', '1.0', '(CASE WHEN e[7] < 0 THEN -2.5::DOUBLE ELSE 2.5::DOUBLE END)')[j]}, 4) AS m{i}{j}" for i, row in enumerate(TURN_ROWS) for j, x in enumerate(row))
    + ", round(e[4], 4) AS m03, round(e[5], 4) AS m13, round(e[6], 4) AS m23 FROM t",
)


def subject_files(df: DataFrame) -> DataFrame:
    """Two files a subject: an image, and a label at another spacing."""
    key = F.col("vec_id") % 2
    spacing = F.when(key == 0, F.array(*[F.lit(s) for s in SPACING])).otherwise(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.25)))
    return df.select(F.floor(F.col("vec_id") / 2).alias("subject"), key.alias("key"), (key == 1).alias("is_label"), "shape", spacing.alias("spacing"), "data")


def files(df: DataFrame) -> DataFrame:
    return df.select("subject", "key", F.posexplode("data").alias("i", "v")).select("subject", "key", "i", rounded("v").alias("v"))


def by_key(image: tuple[tuple[int, int, int], str], label: tuple[tuple[int, int, int], str], extra: str = "") -> str:
    part = lambda key, size, value: f"SELECT subject, {key}::BIGINT AS key, o::INT AS i, {sql_rounded(value)} AS v FROM (SELECT *, (o % {size[0]})::INT AS x, ((o // {size[0]}) % {size[1]})::INT AS y, (o // {size[0] * size[1]})::INT AS z FROM (SELECT vec_id // 2 AS subject, embedding::DOUBLE[] AS e{extra} FROM embeddings WHERE vec_id % 2 = {key} AND EXISTS (FROM embeddings r WHERE r.vec_id = embeddings.vec_id // 2 * 2)), range({size[0] * size[1] * size[2]}) t(o))"
    return f"{part(0, *image)} UNION ALL {part(1, *label)}"


add("multi_file_align", lambda df: files(subjects.align(subject_files(df))), by_key(((4, 4, 4), at("x", "y", "z")), ((8, 4, 2), at("least(floor((x + 0.5) * 4 / 8), 3)", "y", "least(floor((z + 0.5) * 4 / 2), 3)"))))
add("spatial_normalize", lambda df: files(subjects.normalize(subject_files(df))), by_key(((4, 4, 8), blended("x", "y", "(z * 3 / 7.0::DOUBLE)")), ((8, 4, 4), at("least(floor((x + 0.5) * 4 / 8), 3)", "y", "z"))))
STARTS = ", ".join(f"floor({u(SEED_KEY, chr(39) + 'crop' + chr(39), '(vec_id // 2)', chr(39) + str(k) + chr(39))} * 3)::INT AS {c}0" for k, c in enumerate("xyz"))
add("coordinated_crop", lambda df: files(subjects.coordinated_crop(subject_files(df), [2, 2, 2], SEED)), by_key(((2, 2, 2), at("x + x0", "y + y0", "z + z0")), ((2, 2, 2), at("x + x0", "y + y0", "z + z0")), ", " + STARTS))
BOX = ", ".join(f"floor({u(SEED_KEY, chr(39) + 'box' + chr(39), 'vec_id', 'k', chr(39) + str(a) + chr(39))} * {4 - s + 1})::INT AS {c}0" for a, (c, s) in enumerate(zip("xyz", (2, 4, 2), strict=True)))
add("loader_exact_n", lambda df: sampling.exact_starts(df, [2, 4, 2], 6, SEED), f"SELECT vec_id, (x // 2 + 2 * (z // 2))::INT AS k, x::INT AS x0, 0::INT AS y0, z::INT AS z0 FROM embeddings, range(0, 3, 2) a(x), range(0, 3, 2) b(z) UNION ALL SELECT vec_id, (k + 4)::INT AS k, x0, y0, z0 FROM (SELECT vec_id, k, {BOX} FROM embeddings, range(2) t(k))")
add("loader_truncated", lambda df: sampling.exact_starts(df, [2, 4, 2], 3, SEED), "SELECT vec_id, (x // 2 + 2 * (z // 2))::INT AS k, x::INT AS x0, 0::INT AS y0, z::INT AS z0 FROM embeddings, range(0, 3, 2) a(x), range(0, 3, 2) b(z) WHERE x // 2 + 2 * (z // 2) < 3")


def profiler_bottlenecks(spark: SparkSession, sf_dir: str, threshold: float = 50.0) -> DataFrame:
    """Operations whose mean time exceeds a threshold, slowest first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return e.where(F.col("mean") > threshold).orderBy(F.desc("mean")).select("event_type", F.round("mean", 4).alias("mean"), "n")


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation, extremes and median of each operation."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type")
    out = e.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.median("value").alias("median"))
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "std", "least", "most", "median")])


BOTTLENECKS = "SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1 HAVING avg(value) > 50 ORDER BY avg(value) DESC"
BENCHMARK = "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS least, round(max(value), 4) AS most, round(median(value), 4) AS median FROM events GROUP BY 1"


def profiler_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total, mean, extremes and share of time of each operation."""
    e = diagnostics.summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")
    return e.select("event_type", "n", F.round("total", 2).alias("total"), *[F.round(c, 4).alias(c) for c in ("mean", "least", "most")], F.round("percent", 3).alias("percent"))


def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of users with even ids against the others."""
    e = diagnostics.compared(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", F.col("user_id") % 2 == 0)
    return e.select("event_type", *[F.round(c, 4).alias(c) for c in ("baseline", "other", "speedup")])


def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as durations and as sizes."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", diagnostics.duration(F.floor(F.col("value")) * 1000).alias("took"), diagnostics.size(F.floor(F.col("value")) * 1000000).alias("size"))


COMPARE = "SELECT event_type, round(a, 4) AS baseline, round(b, 4) AS other, round(a / b, 4) AS speedup FROM (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 <> 0) AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"
FORMATTED = "SELECT event_id, CASE WHEN t < 1 THEN printf('%.1f us', t * 1000.0) WHEN t < 1000 THEN printf('%.1f ms', t * 1.0) WHEN t < 60000 THEN printf('%.2f s', t / 1000.0) ELSE printf('%d min %.0f s', t // 60000, (t % 60000) / 1000.0) END AS took, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT event_id, floor(value)::BIGINT * 1000 AS t, floor(value)::BIGINT * 1000000 AS n FROM events)"


def _saved(spark: SparkSession, sf_dir: str, compression: str = "none", dtype: str = "float32") -> str:
    """The folder to which all volumes were written, with the affines of their labels; this runs the write."""
    folder = volume_files.work_folder(spark, "volumes")
    volume_files.save(placed(volumes(spark, sf_dir)), folder, compression=compression, dtype=dtype).write.format("noop").mode("overwrite").save()
    return folder


def _by_id(df: DataFrame) -> DataFrame:
    return df.withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.[a-z.]+$", 1).cast("long"))


def _voxels(df: DataFrame) -> DataFrame:
    return _by_id(df).select("vec_id", F.posexplode("data").alias("i", "v"))


FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "files_load": lambda spark, sf: _voxels(volume_files.load(spark, _saved(spark, sf))),
    "files_load_gzip": lambda spark, sf: _voxels(volume_files.load(spark, _saved(spark, sf, "gzip"))),
    "files_load_cropped": lambda spark, sf: _voxels(volume_files.load_cropped(spark, _saved(spark, sf), [1, 0, 2], [2, 3, 2])),
    "files_load_cropped_gzip": lambda spark, sf: _voxels(volume_files.load_cropped(spark, _saved(spark, sf, "mgzip", "float64"), [1, 0, 2], [2, 3, 2])),
    "files_header": lambda spark, sf: _by_id(volume_files.info(volume_files.load_header(spark, _saved(spark, sf, "gzip", "int16")))).select("vec_id", "orientation", "dtype", "num_voxels", "data_size", *[F.get("spacing", k).alias(f"s{k}") for k in range(3)]),
    "files_convert_mgzip": lambda spark, sf: _converted(spark, _saved(spark, sf)),
    "files_load_with_crop": lambda spark, sf: _voxels(volume_files.load_with_crop(spark, _saved(spark, sf, dtype="float64"), volume_files.CropConfig((2, 4, 4), None, None, "LPS"))).withColumn("v", rounded("v")),
}


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    target = volume_files.work_folder(spark, "members")
    volume_files.convert_to_mgzip(spark, folder, target).write.format("noop").mode("overwrite").save()
    return _voxels(volume_files.load(spark, target))


CROPPED = "SELECT vec_id, o::INT AS i, embedding[(2 + o % 2 + 4 * ((o // 2) % 3) + 16 * (2 + o // 6))::INT]::DOUBLE AS v FROM embeddings, range(12) t(o)"
#: The central 2 x 4 x 4 of each volume, turned to LPS: two voxels lie along its first axis, which is the third for the permuted affine.
CENTRE = {0: ((2, 4, 4), at("2 - x", "3 - y", "z")), 1: ((2, 4, 4), at("x + 1", "y", "z")), 2: ((2, 4, 4), at("x + 1", "3 - y", "z")), 3: ((4, 4, 2), at("z + 1", "x", "3 - y"))}
FILE_ORACLES = {
    "files_load": IDENTITY,
    "files_load_gzip": IDENTITY,
    "files_load_cropped": CROPPED,
    "files_load_cropped_gzip": CROPPED,
    "files_convert_mgzip": IDENTITY,
    "files_header": "SELECT vec_id, CASE label % 4 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'LAS' ELSE 'SLA' END AS orientation, 'int16' AS dtype, 64::BIGINT AS num_voxels, 128::BIGINT AS data_size, 1::DOUBLE AS s0, 1::DOUBLE AS s1, 2.5::DOUBLE AS s2 FROM embeddings",
    "files_load_with_crop": " UNION ALL ".join(f"SELECT vec_id, o::INT AS i, {sql_rounded(v)} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, o, (o % {n[0]})::INT AS x, ((o // {n[0]}) % {n[1]})::INT AS y, (o // {n[0] * n[1]})::INT AS z FROM embeddings, range(32) t(o) WHERE label % 4 = {k})" for k, (n, v) in CENTRE.items()),
}


PROFILER = "WITH e AS (SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1) SELECT event_type, n, round(total, 2) AS total, round(total / n, 4) AS mean, round(least, 4) AS least, round(most, 4) AS most, round(100 * total / sum(total) OVER (), 3) AS percent FROM e"


def _over_volumes(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(volumes(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_volumes(q) for name, q in QUERIES.items()} | {"profiler_summary": profiler_summary, "profiler_bottlenecks": profiler_bottlenecks, "benchmark_summary": benchmark_summary, "benchmark_compare": benchmark_compare, "formatted_values": formatted_values} | FILE_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"profiler_summary": PROFILER, "profiler_bottlenecks": BOTTLENECKS, "benchmark_summary": BENCHMARK, "benchmark_compare": COMPARE, "formatted_values": FORMATTED} | FILE_ORACLES
