"""Embedding whitening by a distributed singular value decomposition.

Each component c counts as the long floor(64 * c) + 1000000. The fit list holds every distinct
vector once; its sums by dimension are exact longs. MLlib's computeSVD takes the rows of the list
centred on their mean: right singular vectors are the unit eigenvectors of the covariance, and
squared singular values over n (the divisor of every covariance here) its eigenvalues. All singular
values are asked for, since MLlib then decomposes the Gram matrix directly, to double precision;
that matrix has the square of the vectors' length, whatever the number of rows. The total variance is
not the sum of these values: it comes from the exact integer deviations of the list's rows.

Copies go before the fit with a partial aggregate, so a hot vector is one row of it. Rows are then
whitened where they lie; only sums and the model, of fixed size, travel.

Defined results: null vectors and those with null, NaN or infinite entries are dropped, as are those with
entries of 2^53 / 64 or more, which doubles no longer tell apart; rows that share an id each get their own rows; a null id
stays null. Vectors of each length are fitted apart. Components without variance can't be whitened, so a list of fewer
distinct vectors, or of flat ones, gives fewer components, and one distinct vector none. A deviation beyond a long is null. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.store import dropped, written
from gleanery.llm.vector_dedup import _matrix

#: Steps of a component in one unit, what is added to make them positive, and the components returned at most.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Singular values below this part of the largest are none: rounding of the Gram matrix leaves about its square root.
LEAST = 1e-7


def stepped(embedding: str):
    """The vector as longs, null where it takes no part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**53 // STEPS)))
    return F.when(fine, F.transform(v, lambda c: F.floor(c * STEPS).cast("long") + F.lit(SHIFT).cast("long")))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(n * x - S) of each row and the sums of its squares, exact: in 64 bits where they fit, as Python's integers where not."""
    low, high = int(x.min(initial=SHIFT)), int(x.max(initial=SHIFT))
    most = max(abs(n * v - s) for v in (low, high) for s in (int(sums.min()), int(sums.max())))
    off = x.astype(np.int64) * n - sums if n * max(abs(low), abs(high)) < 2**62 else x.astype(object) * n - sums.astype(object)
    if most**2 * max(1, x.shape[1]) >= 2**63:
        off = off.astype(object)
    return off, [int(d) for d in (off * off).sum(axis=1)]


class Model:
    """What the fit of one length gives: n, sums, directions as rows with their eigenvalues, the total variance, the identity error."""

    def __init__(self, n: int, sums: np.ndarray, directions: np.ndarray, values: np.ndarray, trace: float, error: float):
        self.n, self.sums, self.directions, self.values, self.trace, self.error = n, sums, directions, values, trace, error

    def whitened(self, off: np.ndarray) -> np.ndarray:
        """Of rows n * x - S. Each row is worked out alone, so equal vectors give equal values wherever they lie."""
        return np.einsum("rd,cd->rc", off.astype(np.float64) / self.n, self.directions) / np.sqrt(self.values)


def _centred(fit: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """Column c: the rows of the fit list less their mean, as MLlib's vectors. (n * x - S) / n has one rounding."""
    mean = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    rows = fit.select(array_to_vector(F.zip_with("x", mean, lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n)))).alias("c"))
    return MLUtils.convertVectorColumnsFromML(rows, "c")


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a table of distinct vectors x of one length; None if they have none or are all the same."""
    sums = [(r.pos, r.n, r.s) for r in fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()]
    if not sums or sums[0][1] < 2:
        return None
    n, total = sums[0][1], np.array([s for _, _, s in sorted(sums)], dtype=np.int64)

    def spent(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(deviations(x, n, total)[1])) if len(x) else 0.0])], names=["v"])

    trace = (fit.select("x").mapInArrow(spent, "v double").agg(F.sum("v").alias("v")).first().v or 0.0) / float(n) ** 3
    centred = RowMatrix(_centred(fit, n, total), n, len(total))
    found = centred.computeSVD(len(total), computeU=False, rCond=LEAST)
    values = np.asarray(found.s)[:components] ** 2 / n
    directions = found.V.toArray().T[: len(values)]
    # The covariance of the whitened list, by another pass over it; MLlib centres, and divides by n - 1.
    project = DenseMatrix(len(total), len(values), (directions / np.sqrt(values)[:, None]).ravel().tolist())
    error = np.abs(centred.multiply(project).computeCovariance().toArray() * ((n - 1) / n) - np.eye(len(values))).max()
    return Model(n, total, directions, values, trace, float(error))


def whitened(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(key).alias("id"), stepped(embedding).alias("x")).where("x is not null")
    distinct = written(rows.select("x").distinct())
    models = {}
    for (dim,) in distinct.select(F.size("x").alias("dim")).distinct().collect():
        if dim and (model := fitted(distinct.where(F.size("x") == dim), components)):
            models[dim] = model
    dropped(distinct)
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    kind = vectors.schema[key].dataType.simpleString()
    out = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim, model in sent.value.items():
                where = np.flatnonzero(dims == dim)
                if not len(where):
                    continue
                off, spread = deviations(_matrix(batch.column(1).take(pa.array(where))), model.n, model.sums)
                k = len(model.values)
                rows, parts = np.repeat(where, k), np.tile(np.arange(k), len(where))
                fits = [d if d < 2**63 else None for d in spread]
                columns = [
                    batch.column(0).take(pa.array(rows)), pa.array(parts + 1, pa.int32()), pa.array(np.full(len(rows), model.n)), pa.array(fits, pa.int64()).take(pa.array(np.repeat(np.arange(len(where)), k))),
                    pa.array(model.whitened(off).ravel()), pa.array((model.values / model.trace)[parts]), pa.array(np.full(len(rows), model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x", F.size("x").alias("dim")).mapInArrow(run, out)
