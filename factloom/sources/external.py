"""Connectors to services outside the corpus. Each takes its client, so that nothing here needs a network."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Errors worth another try, by a part of their type or message.
RETRYABLE = ("timeout", "connection", "reset", "temporarily")


def with_retry(call: Callable[[], object], attempts: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it gives a result; waits double after each retryable error."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not (isinstance(e, ValueError) or any(w in f"{type(e).__name__} {e}".lower() for w in RETRYABLE)):
                raise
            sleep(delay * 2**i)


def paginated(fetch: Callable[[int, int], list[dict]], size: int = 100) -> Iterator[dict]:
    """All items of a service that is read page by page until a short page."""
    start = 0
    while True:
        page = with_retry(lambda: fetch(start, size))
        yield from page
        if len(page) < size:
            return
        start += size


def library_items(spark: SparkSession, fetch: Callable[[int, int], list[dict]], schema: str) -> DataFrame:
    return spark.createDataFrame(list(paginated(fetch)), schema)


def first_pdf(children: DataFrame, parent: str = "parent") -> DataFrame:
    """The first PDF attachment of each item."""
    pdf = children.where((F.col("item_type") == "attachment") & F.lower("content_type").contains("pdf"))
    return pdf.groupBy(parent).agg(F.min_by("key", "pos").alias("pdf_key"))


def download(key: str, folder: str, fetch: Callable[[str], bytes]) -> str:
    """Write one file unless it is there; the state is exists, ok or failed."""
    target = os.path.join(folder, f"{key}.pdf")
    if os.path.exists(target):
        return "exists"
    try:
        body = with_retry(lambda: fetch(key))
    except Exception:
        return "failed"
    with open(target, "wb") as f:
        f.write(body)
    return "ok"


def page_images(pdfs: DataFrame, raster: Callable[[bytes, int], list[bytes]], dpi: int = 150) -> DataFrame:
    """key, page, image (base64 PNG) of binary PDFs; a PDF that fails gives no pages."""

    def work(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for key, content in zip(pdf["key"], pdf["content"]):
                try:
                    rows += [(key, i + 1, p) for i, p in enumerate(raster(content, dpi))]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["key", "page", "png"])

    return pdfs.select("key", "content").mapInPandas(work, "key string, page int, png binary").select("key", "page", F.base64("png").alias("image"))


def call_model(prompts: DataFrame, client: Callable[[str], str], keys: list[str], batch: int | None = None) -> DataFrame:
    """keys, response, error: one call of the client for each prompt; a failed one is an error in its row, not of the job."""
    names = [*keys, "response", "error"]
    types = dict(prompts.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "response string", "error string"])

    def work(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append([*(row[k] for k in keys), with_retry(lambda r=row: client(r["prompt"])), None])
                except Exception as e:
                    rows.append([*(row[k] for k in keys), None, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=names)

    return prompts.select(*keys, "prompt").mapInPandas(work, schema)
