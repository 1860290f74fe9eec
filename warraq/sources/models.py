"""Calls of a user's recogniser over images, and replay of stored responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.session import small

#: (image bytes, prompt) -> text; made once per partition by a factory, so that a model loads once.
Transcriber = Callable[[bytes, str], str]


def transcribe(plan: DataFrame, images: DataFrame, prompts: DataFrame, factory: Callable[[], Transcriber], by: str = "n", pause: float = 0.0, retries: int = 0) -> DataFrame:
    """Run a plan of (system, variant, n) over images: (system, variant, n, text, error).

    A failing item is tried ``retries`` times more, with twice the pause each time, then yields an empty text
    and its error; the rest goes on. A missing answer is "". Calls of a task are ``pause`` seconds apart, so that a
    service sees no more calls a second than there are tasks divided by the pause.
    """
    work = plan.join(images.select(by, "content"), by).join(small(prompts.select("variant", "prompt")), "variant")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in batches:
            out = []
            for system, variant, n, content, prompt in pdf[["system", "variant", "n", "content", "prompt"]].itertuples(index=False):
                for attempt in range(retries + 1):
                    try:
                        call = call or factory()
                        row = (system, variant, n, call(bytes(content), prompt) or "", None)
                    except Exception as e:  # noqa: BLE001 - one bad item must not end the batch
                        row = (system, variant, n, "", f"{type(e).__name__}: {e}")
                    time.sleep(pause * 2**attempt)
                    if row[-1] is None:
                        break
                out.append(row)
            yield pd.DataFrame(out, columns=["system", "variant", "n", "text", "error"])

    return work.mapInPandas(run, "system string, variant string, n int, text string, error string")


def local_model(load: Callable[[], Callable[[bytes], str]]) -> Callable[[], Transcriber]:
    """A factory for :func:`transcribe` around a model on the workers: ``load`` imports and loads it, once a task.

    A model that can't be imported or loaded fails each item with ``ModelUnavailable``; the run ends with its
    errors listed instead of stopping.
    """

    def factory() -> Transcriber:
        try:
            model = load()
        except Exception as e:
            raise ModelUnavailable(f"{type(e).__name__}: {e}") from e
        return lambda image, prompt: model(image)

    return factory


class ModelUnavailable(RuntimeError):
    pass


def crop_top(images: DataFrame, fraction: float = 0.5, quality: int = 92) -> DataFrame:
    """Images cut to their upper part; needs an imaging library on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from PIL import Image
        except ImportError as e:
            raise RuntimeError("cropping images needs Pillow on the workers") from e
        for pdf in batches:
            cut = []
            for content in pdf["content"]:
                im = Image.open(io.BytesIO(content)).convert("RGB")
                buf = io.BytesIO()
                im.crop((0, 0, im.width, int(im.height * fraction))).save(buf, "JPEG", quality=quality)
                cut.append(buf.getvalue())
            yield pdf.assign(content=cut)

    return images.mapInPandas(run, images.schema)
