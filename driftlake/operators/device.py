"""Which device and precision a model gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DevicePlan:
    device: str
    total_gb: float | None
    quantize_bits: int | None
    dtype: str

    @property
    def quantized(self) -> bool:
        return self.quantize_bits is not None


def plan(device: str, total_gb: float | None, quantize_below_gb: float) -> DevicePlan:
    """Small GPUs quantise to 4 bits, unless the threshold is 0."""
    if device == "cuda":
        small = quantize_below_gb > 0 and total_gb is not None and total_gb < quantize_below_gb
        return DevicePlan(device, total_gb, 4 if small else None, "bfloat16")
    return DevicePlan(device, None, None, "float16" if device == "mps" else "float32")


def bits(device: Column, total_gb: Column, quantize_below_gb: Column) -> Column:
    return F.when((device == "cuda") & (quantize_below_gb > 0) & (total_gb < quantize_below_gb), 4)


def dtype(device: Column) -> Column:
    return F.when(device == "cuda", "bfloat16").when(device == "mps", "float16").otherwise("float32")


def detect() -> tuple[str, float | None]:
    """(device, memory in GB) of this machine: cuda, mps or cpu; cpu where no framework is installed."""
    try:
        import torch
    except ImportError:
        return "cpu", None
    if torch.cuda.is_available():
        return "cuda", torch.cuda.get_device_properties(0).total_memory / 2**30
    return ("mps", None) if torch.backends.mps.is_available() else ("cpu", None)


def plan_here(quantize_below_gb: float = 16.0) -> DevicePlan:
    return plan(*detect(), quantize_below_gb)


def loader_arguments(chosen: DevicePlan) -> dict:
    """What a model is loaded with: its precision, and where quantised weights are placed."""
    out: dict = {"dtype": chosen.dtype}
    if chosen.quantize_bits:
        out |= {"quantize_bits": chosen.quantize_bits, "compute_dtype": chosen.dtype, "device_map": {"": 0}}
    return out


def inference_device(chosen: DevicePlan) -> str:
    """Where inputs go; a quantised model stays on the first card."""
    return "cuda:0" if chosen.device == "cuda" else chosen.device


def peak_memory_gb() -> float:
    """The most that models took on the card so far; 0 without one."""
    try:
        import torch
    except ImportError:
        return 0.0
    return torch.cuda.max_memory_allocated() / 2**30 if torch.cuda.is_available() else 0.0
