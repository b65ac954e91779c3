"""Operators by name, and the place to add plane kernels of one's own."""

from __future__ import annotations

from collections.abc import Callable

from .functions import stencils
from .operators import admin, diff, flats, incremental, layers, mesh, metadata, ordering, schema_drift, spikes, volume

MODULES = (volume, flats, layers, admin, metadata, mesh, ordering, incremental, diff, spikes, schema_drift)
OPERATORS: dict[str, Callable] = {
    f"{m.__name__.rpartition('.')[2]}.{n}": f for m in MODULES for n, f in vars(m).items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", None) == m.__name__
}
KERNELS: dict[str, stencils.Kernel] = {"clean": stencils.clean, "band_pass": stencils.band_pass}


def register_plane_op(name: str, kernel: stencils.Kernel) -> None:
    """A function of one plane (a NumPy array) that `apply` then runs on every plane of a table."""
    if name in KERNELS:
        raise ValueError(f"{name} is taken")
    KERNELS[name] = kernel


def apply(name: str, planes):  # noqa: ANN001, ANN201
    return stencils.apply_planes(planes, KERNELS[name])
