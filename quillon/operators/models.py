"""Runners of local models, and image decoding; their libraries are optional and imported where they are used."""

from __future__ import annotations

import hashlib
import importlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Number types of weights by option; any other option means the last.
DTYPES = {"bfloat16": "bfloat16", "float16": "float16", "float32": "float32"}
#: The largest side that an image is decoded at; larger ones are an error row.
MAX_SIDE = 20_000


_held: tuple[str, Any] | None = None


def held(key: str, load: Callable[[], Any]) -> Any:
    """The runner of this worker process: loaded for the first row that needs it and kept for later tasks, one at a time."""
    global _held
    if _held is None or _held[0] != key:
        _held = None  # the old one's memory goes first
        _held = key, load()
    return _held[1]


def runner_key(load: Callable[[], Any], *options: Any) -> str:
    """The same for equal loaders and options, in every job."""
    return hashlib.sha1(cloudpickle.dumps((load, options))).hexdigest()


def task_resources(gpus: float, cpus: int = 1):
    """A stage's resources: so many GPUs and cores a task. The cluster has to offer GPUs as the resource `gpu`."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    tasks = TaskResourceRequests().cpus(cpus).resource("gpu", gpus)
    return ResourceProfileBuilder().require(tasks).require(ExecutorResourceRequests().resource("gpu", max(1, math.ceil(gpus)))).build


def dtype_name(option: str) -> str:
    return DTYPES.get(option, "float32")


def decode_rgb(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGB bytes of an image file."""
    import io

    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("images are decoded with Pillow") from e
    with Image.open(io.BytesIO(data)) as image:
        if max(image.size) > MAX_SIDE:
            raise ValueError(f"image is larger than {MAX_SIDE} on a side")
        rgb = image.convert("RGB")
        return rgb.width, rgb.height, rgb.tobytes()


DECODED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType()),
])


def decoded(images: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes]] = decode_rgb) -> DataFrame:
    """path, width, height, rgb of a scan of image files (path, content); what can't be decoded has an error instead."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((path, *decode(bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=DECODED.names).astype({"width": "Int32", "height": "Int32"})

    return images.select("path", "content").mapInPandas(run, DECODED)


@dataclass
class LocalModel:
    """An image-and-text model of a folder, loaded on the worker that first needs it."""

    model_path: str
    device: str = "cuda"
    dtype: str = "bfloat16"

    def __call__(self) -> LocalModel:
        try:
            torch, transformers = importlib.import_module("torch"), importlib.import_module("transformers")
        except ImportError as e:
            raise RuntimeError("local models need torch and transformers") from e
        self.torch = torch
        self.processor = transformers.AutoProcessor.from_pretrained(self.model_path)
        self.model = transformers.AutoModelForImageTextToText.from_pretrained(self.model_path, torch_dtype=getattr(torch, dtype_name(self.dtype)), device_map=self.device)
        return self

    def generate(self, image_path: str | None, question: str, **options: Any) -> str:
        from PIL import Image

        content = [{"type": "image", "image": Image.open(image_path).convert("RGB")}, {"type": "text", "text": question}]
        inputs = self.processor.apply_chat_template([{"role": "user", "content": content}], add_generation_prompt=True, tokenize=True, return_dict=True, return_tensors="pt").to(self.model.device)
        if not options.get("do_sample"):
            options.pop("temperature", None)
        with self.torch.inference_mode():
            made = self.model.generate(**inputs, **options)
        return self.processor.batch_decode(made[:, inputs["input_ids"].shape[-1] :], skip_special_tokens=True)[0]


def loader(name: str | None, model_path: str, device: str, dtype: str) -> Callable[[], Any]:
    """A function without arguments that loads a runner: module:function called with the three options, or the local model."""
    if name is None:
        return LocalModel(model_path, device, dtype)
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)(model_path=model_path, device=device, dtype=dtype)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no loader {name}") from e
