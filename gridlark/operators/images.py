"""Jobs over tables of pixels: (image_id, height, width, data BINARY in BGR order, as Spark's image source gives them)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAZE_WINDOW = 15
#: Axes up to which a filter is one matrix, and bytes of views that leave a worker together.
WHOLE_AXIS = 256
PIECE_BYTES = 8 << 20


def pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)


def each_image(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The images of a batch, where they lie."""
    for height, width, data in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("data"), strict=True):
        yield np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, 3)


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of 0 to 1."""
    return (0.0722 * image[..., 0] + 0.7152 * image[..., 1] + 0.2126 * image[..., 2]) / 255


def gray8(image: np.ndarray) -> np.ndarray:
    """Luma of 0 to 255 in 16-bit fixed point, as image libraries convert to grey."""
    b, g, r = (image[..., i].astype(np.int32) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def dark_channel(image: np.ndarray, window: int = HAZE_WINDOW) -> np.ndarray:
    low = image.min(axis=2)
    half = window // 2
    p = np.pad(low, half, mode="edge")
    rows = np.lib.stride_tricks.sliding_window_view(p, window, axis=0).min(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(rows, window, axis=1).min(axis=-1)


def quality(image: np.ndarray) -> dict[str, float]:
    """Darkness, flatness, blur, haze and lack of detail; larger is worse."""
    g = gray(image)
    share = np.bincount(np.rint(255 * g).astype(np.uint8).ravel(), minlength=256) / g.size
    some = share[share > 0]
    return {
        "luminance": 1 - float(g.mean()),
        "contrast": 1 - float(g.std()),
        "blur": -float(np.log(laplacian(g).var() + 1e-12)),
        "haze": float(dark_channel(image).mean()) / 255,
        "entropy": 1 + float((some * np.log2(some)).sum()) / 8,
    }


def region_quality(images: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, region_id and the five features of each crop."""
    boxes = regions.groupBy("image_id").agg(F.collect_list(F.struct("region_id", "rx1", "ry1", "rx2", "ry2")).alias("boxes"))
    names = ["luminance", "contrast", "blur", "haze", "entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for image_id, crops, image in zip(b.column("image_id").to_pylist(), b.column("boxes").to_pylist(), each_image(b), strict=True):
                for x in crops:
                    f = quality(image[int(x["ry1"]) : int(x["ry2"]), int(x["rx1"]) : int(x["rx2"])])
                    out.append({"image_id": image_id, "region_id": x["region_id"]} | f)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("image_id", pa.int64()), ("region_id", pa.int32()), *((n, pa.float64()) for n in names)]))

    return images.join(boxes, "image_id").mapInArrow(run, "image_id long, region_id int, " + ", ".join(f"{n} double" for n in names))


@lru_cache(maxsize=16)
def _gamma_table(value: float) -> np.ndarray:
    return _whole(255 * (np.arange(256) / 255.0) ** value)


def _whole(values: np.ndarray) -> np.ndarray:
    near = np.rint(values)
    return np.clip(near, 0, 255, out=near).astype(np.uint8, order="C")


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a cubic interpolation (a = -0.75) that repeats the border."""
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    base = np.floor(at).astype(int)
    w = np.zeros((n_out, n_in))
    for k in range(-1, 3):
        t = np.abs(at - (base + k))
        near, far = 1.25 * t**3 - 2.25 * t**2 + 1, -0.75 * (t**3 - 5 * t**2 + 8 * t - 4)
        np.add.at(w, (np.arange(n_out), np.clip(base + k, 0, n_in - 1)), np.where(t <= 1, near, far))
    return w


def _gaussian(sigma: float, taps: int) -> np.ndarray:
    half = taps // 2
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _filtered(rows: np.ndarray, sigma: float, taps: int) -> np.ndarray:
    """Gaussian of ``taps`` values along the first axis; the border is mirrored without its last row."""
    n, half = len(rows), taps // 2
    p = np.pad(rows, [(half, half)] + [(0, 0)] * (rows.ndim - 1), mode="reflect")
    out = np.zeros(rows.shape)
    for j, weight in enumerate(_gaussian(sigma, taps)):
        out += weight * p[j : j + n]
    return out


@lru_cache(maxsize=64)
def _filter_matrix(n: int, sigma: float, taps: int) -> np.ndarray:
    return _filtered(np.eye(n), sigma, taps)


@lru_cache(maxsize=64)
def _smooth_cubic(n_in: int, n_out: int, sigma: float, taps: int) -> np.ndarray:
    """Weights of the interpolation and the filter after it."""
    return _filtered(_cubic(n_in, n_out), sigma, taps)


def smooth(values: np.ndarray, sigma: float, taps: int) -> np.ndarray:
    """Gaussian of ``taps`` values along both axes; the border is mirrored without its last row."""
    out = np.moveaxis(values, (0, 1), (-2, -1)).astype(float, order="C")  # one plane a channel
    height, width = out.shape[-2:]
    out = _filter_matrix(height, sigma, taps) @ out if height <= WHOLE_AXIS else np.moveaxis(_filtered(np.moveaxis(out, -2, 0), sigma, taps), 0, -2)
    out = out @ _filter_matrix(width, sigma, taps).T if width <= WHOLE_AXIS else np.moveaxis(_filtered(np.moveaxis(out, -1, 0), sigma, taps), 0, -1)
    return np.moveaxis(out, (-2, -1), (0, 1))


def fog(image: np.ndarray, beta: float, seed: int) -> np.ndarray:
    """Light of 0.92 scattered in over a smooth random depth of 0.35 to 1."""
    height, width = image.shape[:2]
    coarse = np.random.Generator(np.random.PCG64(seed)).random((max(2, -(-height // 32)), max(2, -(-width // 32))), dtype=np.float32)
    sigma = max(1.0, max(height, width) / 24)
    taps = round(8 * sigma + 1) | 1
    depth = _smooth_cubic(len(coarse), height, sigma, taps) @ coarse @ _smooth_cubic(coarse.shape[1], width, sigma, taps).T
    depth -= depth.min()
    through = np.exp(-beta * (0.35 + 0.65 * depth / max(depth.max(), 1e-6)))[..., None]
    mixed = image / 255.0
    mixed *= through
    mixed += 0.92 * (1 - through)
    mixed *= 255
    return _whole(mixed)


def low_light(image: np.ndarray, value: float, seed: int) -> np.ndarray:
    return gamma(image, value)


def gaussian_blur(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    return _whole(smooth(image, sigma, max(3, int(np.ceil(6 * sigma)) | 1)))


def gamma(image: np.ndarray, value: float, seed: int = 0) -> np.ndarray:
    return _gamma_table(value)[image]


def unsharp(image: np.ndarray, amount: float, seed: int = 0, sigma: float = 1.2) -> np.ndarray:
    """Another sigma: ``functools.partial(unsharp, sigma=...)`` in the registry."""
    blurred = _whole(smooth(image, sigma, round(6 * sigma + 1) | 1))
    return _whole((1 + amount) * image - amount * blurred.astype(float))


#: Three levels of each corruption.
LEVELS = {"fog": (0.6, 1.0, 1.5), "low_light": (1.5, 2.0, 2.8), "gaussian_blur": (0.8, 1.5, 2.5)}
CORRUPTIONS: dict[str, Callable] = {"fog": fog, "low_light": low_light, "gaussian_blur": gaussian_blur}
ENHANCEMENTS: dict[str, Callable] = {"gamma": gamma, "unsharp": unsharp}

VIEW = "image_id long, kind string, parameter double, seed decimal(20,0), height int, width int, data binary, output_sha256 string"
VIEW_TYPES = [pa.int64(), pa.string(), pa.float64(), pa.decimal128(20, 0), pa.int32(), pa.int32(), pa.binary(), pa.string()]


def apply_views(images: DataFrame, kernels: dict[str, Callable], keep_pixels: bool = True) -> DataFrame:
    """Run a kernel for each of an image's ``jobs``, an array of (kind, parameter, seed); pixels go to the worker once an image.

    Without ``keep_pixels`` the views' pixels are hashed where they are made, and ``data`` is left out."""
    kept = [k for k, c in enumerate(VIEW.split(", ")) if keep_pixels or not c.startswith("data ")]
    schema = ", ".join(VIEW.split(", ")[k] for k in kept)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], VIEW_TYPES[k]) for k in kept], [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for image_id, jobs, image in zip(b.column("image_id").to_pylist(), b.column("jobs").to_pylist(), each_image(b), strict=True):
                for job in jobs:
                    data = kernels[job["kind"]](image, float(job["parameter"]), int(job["seed"])).tobytes()
                    rows.append((image_id, job["kind"], job["parameter"], job["seed"], *image.shape[:2], data, hashlib.sha256(data).hexdigest()))
                    held += len(data)
                    if held >= PIECE_BYTES:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return images.select("image_id", "height", "width", "data", "jobs").mapInArrow(run, schema)


def degraded_views(images: DataFrame, seed: int, levels: dict[str, tuple[float, ...]] = LEVELS, keep_pixels: bool = True) -> DataFrame:
    from ..functions.hashing import stable_seed

    jobs = [F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("parameter"), stable_seed(F.lit(seed), F.col("image_id"), F.lit(k), F.lit(i + 1)).alias("seed")) for k, ps in levels.items() for i, p in enumerate(ps)]
    return apply_views(images.withColumn("jobs", F.array(*jobs)), CORRUPTIONS, keep_pixels)


def enhanced_views(images: DataFrame, parameters: dict[str, float], kernels: dict[str, Callable] | None = None, keep_pixels: bool = True) -> DataFrame:
    """User kernels may be added to the registry that is passed."""
    jobs = [F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("parameter"), F.lit(0).cast("decimal(20,0)").alias("seed")) for k, p in parameters.items()]
    return apply_views(images.withColumn("jobs", F.array(*jobs)), kernels or ENHANCEMENTS, keep_pixels)


def border_stats(images: DataFrame, border: int, white: int = 250) -> DataFrame:
    """image_id, border_mean, white_fraction.  Pixels are read where the batch lies; of an image only its border is copied."""

    def told(b: pa.RecordBatch) -> pa.RecordBatch:
        mean, white_share = [], []
        for image in each_image(b):
            edge = np.ones(image.shape[:2], bool)
            edge[border:-border, border:-border] = False
            outer = image[edge]
            mean.append(float(outer.mean()))
            white_share.append(float((outer >= white).all(axis=1).mean()))
        return pa.RecordBatch.from_arrays([b.column("image_id").cast(pa.int64()), pa.array(mean, pa.float64()), pa.array(white_share, pa.float64())], ["image_id", "border_mean", "white_fraction"])

    # map() lets go of a batch before it asks for the next
    return images.select("image_id", "height", "width", "data").mapInArrow(lambda batches: map(told, batches), "image_id long, border_mean double, white_fraction double")
