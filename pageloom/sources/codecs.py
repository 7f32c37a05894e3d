"""The boundary to byte codecs. They come from libraries that may be missing; a row then says so, nothing is imitated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DECODED = "doc_id string, page_no int, width double, height double, rotation int, error string"
#: format -> function of bytes that returns (width, height, rotation) of each page; filled by whoever has the library.
DECODERS: dict[str, Callable[[bytes], list[tuple[float, float, int]]]] = {}


def decode_documents(files: DataFrame, image_format: str) -> DataFrame:
    """Pages of files (doc_id, content), or a row with an error for a file that can't be read; other files go on."""
    decoder = DECODERS.get(image_format)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[tuple] = []
            for doc, content in pdf.itertuples(index=False):
                if decoder is None:
                    rows.append((doc, None, None, None, None, f"no codec for {image_format}"))
                    continue
                try:
                    rows += [(doc, i + 1, *page, None) for i, page in enumerate(decoder(bytes(content)))]
                except Exception as e:
                    rows.append((doc, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "width", "height", "rotation", "error"])

    return files.select("doc_id", "content").mapInPandas(run, DECODED)
