"""Nearest chunks by exact cosine distance, over what a user may read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from quillmark.functions.predicates import check_limit
from quillmark.operators.permissions import ClassAccess
from quillmark.storage import cut, few

#: Vectors of a tenant's chunks and of its requests that meet in one matrix product.
CHUNK_BLOCK, REQUEST_BLOCK = 8192, 1024
#: Bytes of a block's vectors where all requests meet all chunks of a tenant: the larger the blocks, the fewer copies.
BLOCK_BYTES = 32 << 20
#: A large tenant's requests are in so many blocks at least, so that tasks share them.
LEAST_BLOCKS = 4
#: Requests of a block that are multiplied at a time, with CHUNK_BLOCK chunks; fewer with more.
REQUEST_ROWS = 256
#: Distances this near the k-th are computed again, row by row, so that equal vectors tie exactly.
TIE = 1e-9


def vector_topk(chunks: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest chunks; ties by key, vectors without a distance last."""
    check_limit(k, 1, 100)
    asked = pa.array([[float(x) for x in query]], pa.list_(pa.float64()))

    def distances(vectors: pa.Array) -> pa.Array:
        return _pair_distance(vectors, asked.take(pa.array(np.zeros(len(vectors), np.int64))))

    away = chunks.withColumn("distance", F.arrow_udf(distances, "double")(vector))
    return away.withColumn("similarity", 1.0 - F.col("distance")).orderBy(F.asc_nulls_last("distance"), key).limit(k)


def _nearest(rows: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("distance"), key))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("similarity", 1.0 - F.col("distance"))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this width as rows of length 1, and which they are; others and those without a length are 0."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    fits = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
    out = np.zeros((len(lists), width))
    some = lists.filter(pa.array(fits))
    out[fits] = some.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.sqrt((out * out).sum(axis=1))
    good = fits & (norm > 0) & np.isfinite(norm)
    out[good] /= norm[good, None]
    out[~good] = 0
    return out, good


def _pair_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """cosine_distance of each row's two vectors, by batches; null where one has no length or their lengths differ."""
    lengths = a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out, known = np.zeros(len(a)), np.zeros(len(a), bool)
    for width in np.unique(lengths[lengths > 0]):
        x, good = _matrix(a, int(width))
        y, also = _matrix(b, int(width))
        both = good & also
        out[both], known[both] = 1.0 - (x[both] * y[both]).sum(axis=1), True
    return pa.array(out, mask=~known)


def rank_by_distance(pairs: DataFrame, by: list[str], k: int, key: str = "chunk_id") -> DataFrame:
    """Of rows that hold a query and an embedding, the k nearest of each group; neither vector is kept."""
    check_limit(k, 1, 100)
    near = pairs.withColumn("distance", F.arrow_udf(_pair_distance, "double")("embedding", "query")).drop("embedding", "query")
    return _nearest(near, by, k, key)


def _blocks(rows: DataFrame, sizes: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """rows once for each block of the other side, with its own block by a hash of its key."""
    joined = rows.join(sizes, ["organization_id", "embedding_model"])
    return joined.withColumn(own, F.pmod(F.xxhash64(key), f"n_{own}").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(f"n_{other}") - 1).cast("int")))).drop(f"n_{own}", f"n_{other}")


def _best(left: pa.Table, right: pa.Table, k: int, permitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, chunk, distance; infinite where there is none) of the k nearest chunks of left for each request of right.

    permitted: [request, chunk], all if it isn't given.  A block's distances are matrix products.
    """
    rows, columns, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    queries, embeddings = right["query"].combine_chunks(), left["embedding"].combine_chunks()
    order = pa.compute.rank(left["chunk_id"].combine_chunks(), tiebreaker="first").to_numpy()
    widths = queries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    step = max(1, REQUEST_ROWS * CHUNK_BLOCK // max(len(embeddings), CHUNK_BLOCK))
    for width in np.unique(widths):
        q, asks = _matrix(queries, int(width))
        c, has = _matrix(embeddings, int(width))
        for some in np.split(mine := np.flatnonzero(widths == width), range(step, len(mine), step)):
            all_ = 1.0 - q[some] @ c.T
            all_[:, ~has] = np.inf
            all_[~asks[some]] = np.inf
            for i, d in zip(some, all_, strict=True):
                near = np.arange(len(d)) if permitted is None else np.flatnonzero(permitted[i])
                if len(near) > k:
                    limit = np.partition(d[near], k - 1)[k - 1]
                    near = near[d[near] <= limit + TIE] if np.isfinite(limit) else near
                sure = np.where(np.isfinite(d[near]), 1.0 - (c[near] * q[i]).sum(axis=1), np.inf)
                best = np.lexsort((order[near], sure))[:k]
                rows.append(np.full(len(best), i))
                columns.append(near[best])
                distances.append(sure[best])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(distances)


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of the tenant's chunks for each request.  queries: organization_id, user_id, query, embedding_model.

    Every request meets every chunk of its tenant, as exact search must; they meet in blocks, whose distances are
    one matrix product, and only each block's k nearest leave it.  A large tenant has many blocks, so it isn't one
    task's.  A vector goes to each block of the other side, so blocks are as large as BLOCK_BYTES lets them be.
    Sizes are a row for each tenant and model, broadcast if they are few.
    """
    check_limit(k, 1, 100)
    keys = ["organization_id", "embedding_model"]
    own = chunks.filter(F.col("embedding").isNotNull()).select(*keys, F.col("id").alias("chunk_id"), "embedding")
    asked = queries.select(*keys, "user_id", "query")
    held = lambda df, vector, n, width: df.groupBy(*keys).agg(F.count("*").alias(n), F.max(F.size(vector)).alias(width))
    sizes = held(own, "embedding", "_nc", "_wc").join(held(asked, "query", "_nr", "_wr"), keys)
    block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / 8 / F.greatest("_wc", "_wr", F.lit(1))))
    shared = F.least(F.ceil(F.col("_nr") / REQUEST_BLOCK), F.lit(LEAST_BLOCKS))
    sizes = few(sizes.select(*keys, F.ceil(F.col("_nc") / block).alias("n_cb"), F.greatest(F.ceil(F.col("_nr") / block), shared).alias("n_rb")))
    ids = {c: chunks.schema["id"].dataType if c == "chunk_id" else queries.schema[c].dataType for c in ("organization_id", "user_id", "chunk_id")}

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        at, of, d = _best(left, right, k)
        at, of = pa.array(at), pa.array(of)
        return pa.table({"organization_id": right["organization_id"].take(at), "user_id": right["user_id"].take(at), "chunk_id": left["chunk_id"].take(of), "embedding_model": right["embedding_model"].take(at), "distance": pa.array(d, mask=~np.isfinite(d))})

    at = [*keys, "cb", "rb"]
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in ids.items()) + ", embedding_model string, distance double"
    met = _blocks(own, sizes, "cb", "rb", "chunk_id").groupBy(*at).cogroup(_blocks(asked, sizes, "rb", "cb", "user_id").groupBy(*at)).applyInArrow(product, schema)
    return _nearest(met, ["organization_id", "user_id"], k, "chunk_id")


def indexable_content(versions: DataFrame, mappings: DataFrame, documents: DataFrame, chunks: DataFrame, model: str | None = None) -> DataFrame:
    """Embedded chunks of ready documents of current, available versions."""
    current = versions.filter("is_current and lifecycle = 'available'").select("organization_id", F.col("id").alias("document_version_id"), "source_item_id")
    ready = documents.filter("status = 'ready' and deleted_at is null").select("organization_id", F.col("id").alias("document_id"), F.col("title").alias("document_title"), "source_type", "source_document_key")
    held = chunks.filter(F.col("embedding").isNotNull()).select("organization_id", "document_id", F.col("id").alias("chunk_id"), "chunk_index", "chunk_text", "embedding", "embedding_model")
    if model is not None:
        held = held.filter(F.col("embedding_model") == model)
    return version_chunks(current, mappings, ready, held)


def version_chunks(versions: DataFrame, mappings: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    joined = versions.join(mappings.select("organization_id", "document_version_id", "document_id"), ["organization_id", "document_version_id"])
    return joined.join(documents, ["organization_id", "document_id"]).join(chunks, ["organization_id", "document_id"])


def with_current_index(df: DataFrame, states: DataFrame, dimensions: int) -> DataFrame:
    """The rows whose version is indexed at the generation asked for, with their own model."""
    good = (F.col("status") == "indexed") & (F.col("indexed_generation") == F.col("desired_generation")) & (F.col("embedding_dimensions") == dimensions)
    keys = ["organization_id", "document_version_id", "embedding_model"]
    return df.join(states.filter(good).select(keys).distinct(), keys, "left_semi")


def _dealt(rows: DataFrame, klass: str, key: str, block: int, out: str) -> DataFrame:
    """rows with the number of their block: a class stays in one, or is dealt over as many as it fills."""
    keys = ["organization_id", "embedding_model"]
    classes = cut(rows.groupBy(*keys, klass).agg(F.ceil(F.count("*") / block).alias("_parts"), F.count("*").alias("_n")))
    blocks = few(classes.groupBy(*keys).agg(F.ceil(F.sum("_n") / block).alias("_blocks")))
    joined = rows.join(few(classes.drop("_n")), [*keys, klass]).join(blocks, keys)
    return joined.withColumn(out, F.pmod(F.xxhash64(klass, F.pmod(F.xxhash64(key), "_parts")), "_blocks").cast("int")).drop("_parts", "_blocks")


def permission_blocks(granted: ClassAccess, chunks: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organization_id, embedding_model, cb, rb, user_class, yes, no) and (organization_id, embedding_model, cb, place, path).

    The paths of a block of chunks are numbered by class of items and scope.  `yes` are the paths that a class of
    users of a block of requests may use (a class of null is everyone), `no` those of everyone's that it may not.
    """
    keys = ["organization_id", "embedding_model"]
    held = chunks.select(*keys, "cb", "item_class").distinct()
    asking = cut(asked.select(*keys, "rb", "user_class").distinct())
    columns = ["connector_scope_id", "knowledge_space_id"]
    used = granted.access.select("organization_id", "item_class", *columns).distinct()
    number = F.row_number().over(Window.partitionBy(*keys, "cb").orderBy("item_class", "connector_scope_id")) - 1
    paths = cut(held.join(used, ["organization_id", "item_class"]).withColumn("place", number))
    rules = paths.join(granted.access.select("organization_id", "user_class", "item_class", "connector_scope_id", "permitted"), ["organization_id", "item_class", "connector_scope_id"])
    named = rules.filter("user_class is not null").join(asking, [*keys, "user_class"])
    everyone = rules.filter("user_class is null").join(asking.select(*keys, "rb").distinct(), keys)
    places = lambda yes: F.collect_list(F.when(F.col("permitted") == yes, F.col("place")))
    rows = named.select(*keys, "cb", "rb", "user_class", "permitted", "place").unionByName(everyone.select(*keys, "cb", "rb", "user_class", "permitted", "place"))
    # at most the paths of a block for each class
    return rows.groupBy(*keys, "cb", "rb", "user_class").agg(places(True).alias("yes"), places(False).alias("no")), paths


def _permitted(right: pa.Table, n_paths: int) -> tuple[dict[str, int], np.ndarray]:
    """The classes of users of the mask's rows by number, and [class, path]; the first class has what everyone may."""
    rows = list(zip(right["user_class"].to_pylist(), right["yes"].to_pylist(), right["no"].to_pylist(), strict=True))
    number = {c: i for i, c in enumerate([None, *dict.fromkeys(c for c, yes, _ in rows if yes is not None and c is not None)])}
    out = np.zeros((len(number), n_paths), bool)
    for c, yes, _ in rows:
        if c is None and yes is not None:
            out[:, yes] = True
    for c, yes, no in rows:
        if c is not None and yes is not None:
            out[number[c], yes] = True
            out[number[c], no] = False
    return number, out


def permitted_search(granted: ClassAccess, content: DataFrame, states: DataFrame, requests: DataFrame, k: int, dimensions: int) -> DataFrame:
    """The k nearest chunks that each request's user may read, with the first path that lets the user.

    Chunks and requests meet in blocks whose classes of items and users have some permission, and in no others; the
    block's product is masked by the classes' permissions.  A vector goes once to each such block, and neither users and
    items nor users and chunks are paired but for the k nearest.  requests: organization_id, user_id, query, embedding_model.
    """
    check_limit(k, 1, 100)
    keys = ["organization_id", "embedding_model"]
    ready = with_current_index(content, states, dimensions)
    # chunks without any permitted path, and requests of users who aren't active, drop out before any vector moves
    items = granted.items.join(granted.access.filter("permitted").select("organization_id", "item_class").distinct(), ["organization_id", "item_class"], "left_semi")
    own = cut(_dealt(ready.join(items, ["organization_id", "source_item_id"]).select(*keys, "chunk_id", "source_item_id", "item_class", "embedding"), "item_class", "chunk_id", CHUNK_BLOCK, "cb"))
    asked = cut(_dealt(requests.select(*keys, "user_id", "query").join(granted.users, ["organization_id", "user_id"]), "user_class", "user_id", REQUEST_BLOCK, "rb"))
    mask, paths = permission_blocks(granted, own, asked)
    mask = cut(mask)
    at = [*keys, "cb", "rb"]
    live = few(mask.filter(F.size("yes") > 0).select(at).distinct())
    first = paths.groupBy(*keys, "cb", "item_class").agg(F.min("place").alias("first"), F.count("*").alias("paths"))
    ids = {c: t.dataType for c, t in (("organization_id", requests.schema["organization_id"]), ("user_id", requests.schema["user_id"]), ("chunk_id", content.schema["chunk_id"]), ("source_item_id", content.schema["source_item_id"]))}

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        is_mask = right["user_id"].is_null()
        mask, right = right.filter(is_mask), right.filter(pa.compute.invert(is_mask))
        place, width = left["first"].to_numpy(), left["paths"].to_numpy()
        number, allowed = _permitted(mask, int((place + width).max(initial=0)))
        klass = np.array([number.get(c, 0) for c in right["user_class"].to_pylist()], np.int64)
        starts, item = np.unique(place, return_inverse=True)
        counts = np.zeros(len(starts), np.int64)
        counts[item] = width
        # [class of users, class of items]: the first path that lets it, or -1
        way = np.full((len(allowed), len(starts)), -1)
        for j in range(int(counts.max(initial=0))):
            some = np.flatnonzero(counts > j)
            way[:, some] = np.where((way[:, some] < 0) & allowed[:, starts[some] + j], starts[some] + j, way[:, some])
        of_chunk = way[klass][:, item]
        who, what, d = _best(left, right, k, of_chunk >= 0)
        i, j = pa.array(who), pa.array(what)
        return pa.table({"organization_id": right["organization_id"].take(i), "user_id": right["user_id"].take(i), "chunk_id": left["chunk_id"].take(j), "source_item_id": left["source_item_id"].take(j), "embedding_model": right["embedding_model"].take(i), "cb": left["cb"].take(j), "place": pa.array(of_chunk[who, what], pa.int32()), "distance": pa.array(d, mask=~np.isfinite(d))})

    none = lambda *names: [F.lit(None).cast({"yes": "array<int>", "no": "array<int>"}.get(c) or asked.schema[c].dataType).alias(c) for c in names]
    left = own.join(live, [*keys, "cb"]).join(first, [*keys, "cb", "item_class"]).select(*at, "chunk_id", "source_item_id", "embedding", "first", "paths")
    right = asked.join(live, [*keys, "rb"]).select(*at, "user_id", "user_class", "query", *none("yes", "no")).unionByName(mask.join(live, at, "left_semi").select(*at, *none("user_id"), "user_class", *none("query"), "yes", "no"))
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in ids.items()) + ", embedding_model string, cb int, place int, distance double"
    near = _nearest(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(product, schema), ["organization_id", "user_id"], k, "chunk_id")
    shown = [c for c in content.columns if c not in ("embedding", "embedding_model", "organization_id")]
    found = near.join(paths.select(*keys, "cb", "place", "connector_scope_id", "knowledge_space_id"), [*keys, "cb", "place"]).drop("cb", "place")
    return found.join(ready.select("organization_id", *shown), ["organization_id", "chunk_id", "source_item_id"])
