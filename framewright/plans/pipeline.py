"""Operator graphs: specs are declared, unreachable ones pruned, chains fused, and the rest becomes columns of one DataFrame plan.

Catalyst removes unused columns and evaluates adjacent Python columns in one exchange; fusion here replaces a chain by one kernel, so
intermediates never leave Python. A chain is fused only where no other spec and no output reads an intermediate, and where the fused kernel
knows the arguments (it interpolates bilinearly; a bicubic chain stays unfused).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import media
from ..types import MediaError, within


@dataclass
class Operator:
    """A registered operator: ``build(inputs, args)`` gives its column. ``covers`` names the chain that a fused one stands for."""

    name: str
    build: Callable[[list[Column], dict], Column]
    covers: tuple[str, ...] = ()
    accepts: Callable[[dict], bool] = lambda args: True


REGISTRY: dict[str, Operator] = {}


def register(op: Operator) -> None:
    if op.name in REGISTRY:
        raise MediaError(f"operator {op.name} is registered already")
    REGISTRY[op.name] = op


register(Operator("ToTensor", lambda i, a: media.to_tensor(i[0], a.get("layout", "NCHW"))))
register(Operator("ResizeCrop", lambda i, a: media.resize_crop(i[0], a["resize"], a["crop"], a.get("mode", "bilinear"), a.get("pos", (0.5, 0.5)), a.get("round_mode", "truncate"))))
register(Operator("Normalize", lambda i, a: media.normalize(i[0], a["mean"], a["std"], a.get("scale", 1.0))))
register(Operator("Patches", lambda i, a: media.image_patches(i[0], **a)))
register(
    Operator(
        "ToTensorResizeCropNormalize",
        lambda i, a: media.preprocess(i[0], a["resize"], a["crop"], a["mean"], a["std"], **{k: a[k] for k in ("scale", "pos", "round_mode") if k in a}),
        ("ToTensor", "ResizeCrop", "Normalize"),
        lambda a: a.get("mode", "bilinear") == "bilinear" and a.get("layout", "NCHW") == "NCHW",
    )
)

_numbers = count()


@dataclass
class Spec:
    """A node: operator, names of its inputs, arguments, and the name of its output."""

    op: str
    inputs: list[str]
    args: dict = field(default_factory=dict)
    output: str = ""

    def __post_init__(self) -> None:
        if self.op not in REGISTRY:
            raise MediaError(f"no operator {self.op}")
        self.output = self.output or f"{self.op}_{next(_numbers)}"


def prune(specs: list[Spec], outputs: list[str]) -> list[Spec]:
    """Specs that the outputs need, producers first. Two specs with one output, or a cycle, are errors."""
    by = {}
    for s in specs:
        if s.output in by:
            raise MediaError(f"two operators give {s.output}")
        by[s.output] = s
    order, state = [], {}

    def visit(name: str) -> None:
        if name not in by or state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise MediaError(f"{name} depends on itself")
        state[name] = 1
        for i in by[name].inputs:
            visit(i)
        state[name] = 2
        order.append(by[name])

    for o in outputs:
        visit(o)
    return order


def fuse(specs: list[Spec], outputs: list[str]) -> list[Spec]:
    """Replace chains by the fused operators that cover most of them; arguments are merged by name, the last wins."""
    specs = list(specs)
    fused = sorted((o for o in REGISTRY.values() if o.covers), key=lambda o: -len(o.covers))
    changed = True
    while changed:
        changed = False
        readers = {s.output: [r for r in specs if s.output in r.inputs] for s in specs}
        for op in fused:
            for first in specs:
                chain = [first]
                while len(chain) < len(op.covers) and len(readers[chain[-1].output]) == 1 and chain[-1].output not in outputs:
                    chain.append(readers[chain[-1].output][0])
                if tuple(s.op for s in chain) != op.covers or any(len(s.inputs) != 1 for s in chain):
                    continue
                args = {k: v for s in chain for k, v in s.args.items()}
                if not op.accepts(args):
                    continue
                at = specs.index(chain[-1])
                specs[at] = Spec(op.name, list(first.inputs), args, chain[-1].output)
                specs = [s for s in specs if s not in chain]
                changed = True
                break
            if changed:
                break
    return specs


class Pipeline:
    """Inputs are columns of the DataFrame that ``run`` is given; batch, threads and depth are checked as they are set, and left to Spark."""

    def __init__(self, batch_size: int = 1, num_threads: int = 1, queue_depth: int = 2, auto_fuse: bool = True) -> None:
        within("batch", batch_size)
        within("depth", queue_depth)
        if num_threads < 1:
            raise MediaError("threads must be at least 1")
        self.auto_fuse, self.specs, self.outputs = auto_fuse, [], []

    def build(self, specs: list[Spec], outputs: list[str]) -> Pipeline:
        plan = prune(specs, outputs)
        self.specs, self.outputs = fuse(plan, outputs) if self.auto_fuse else plan, outputs
        return self

    def run(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        for s in self.specs:
            df = df.withColumn(s.output, REGISTRY[s.op].build([F.col(f"`{i}`") for i in s.inputs], s.args))
        return df.select(*[f"`{c}`" for c in [*keep, *[o for o in self.outputs if o not in keep]]])


def pipeline_def(fn: Callable) -> Callable:
    """A function that returns (specs, outputs) as a factory of built pipelines; the pipeline's own options are taken out of its keywords."""

    @wraps(fn)
    def make(*args, **kwargs) -> Pipeline:
        own = {k: kwargs.pop(k) for k in ("batch_size", "num_threads", "queue_depth", "auto_fuse") if k in kwargs}
        specs, outputs = fn(*args, **kwargs)
        return Pipeline(**own).build(specs, outputs)

    return make


def merge_config(base: dict, override: dict) -> dict:
    """Nested settings, the override's values over the base's."""
    return {k: merge_config(base[k], override[k]) if isinstance(base.get(k), dict) and isinstance(override.get(k), dict) else override.get(k, base.get(k)) for k in {**base, **override}}


def first_available(*values):
    """The first value that isn't None."""
    return next((v for v in values if v is not None), None)
