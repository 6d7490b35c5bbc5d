"""Options that make two sketch indexes comparable, and shared column names."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column

#: The columns that identify one indexed (key column, measure column) pair.
PAIR = ["table_id", "key_col", "value_col"]

# Defaults and limits the results must agree with.
DEFAULT_SKETCH_SIZE = 128
COUNTER_QUERY_SIZE = 100
COUNTER_TOP = 10
OVERLAP_TOP = 20
CONTAINMENT_THRESHOLD = 0.5
MIN_VARIANCE = 1e-10
MAX_MEASURE = 1e290
COMPAT_MIN_ROWS = 12
TRAIN_FRACTION = 0.9
IMPORTANCE_SHUFFLES = 20

HASH_ORDERS = ("be", "le_signed", "xxhash64", "sha2")
LABELS = ("paper", "sql")
TERMS = ("md5", "hex")


@dataclass(frozen=True)
class SketchOptions:
    """How keys are sampled and labelled.

    ``size``        keys kept per pair (the n smallest key hashes)
    ``hash_order``  order of the sample: ``be`` (md5, big endian, unsigned),
                    ``le_signed`` (md5, little endian, signed), ``xxhash64``,
                    ``sha2``, or a function Column -> Column
    ``label``       ``paper``: ``+1`` when value > mean; ``sql``: ``+1`` when
                    mean > value. Ties are ``-1`` in both.
    ``term``        ``md5`` of the label, or ``hex`` for the readable bytes
    ``inner_hash``  hash the key itself before the sign is appended
    ``rel_eps``     relative distance from the mean that still counts as a tie
    """

    size: int = DEFAULT_SKETCH_SIZE
    hash_order: str | Callable[[Column], Column] = "be"
    label: str = "paper"
    term: str = "md5"
    inner_hash: bool = False
    rel_eps: float = 0.0

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("sketch size must be at least 1")
        if not callable(self.hash_order) and self.hash_order not in HASH_ORDERS:
            raise ValueError(f"unknown hash order {self.hash_order!r}")
        if callable(self.hash_order) and getattr(self.hash_order, "__name__", "<lambda>") == "<lambda>":
            raise ValueError("a hash order of one's own needs a name, by which indexes are told apart")
        if self.label not in LABELS:
            raise ValueError(f"unknown label convention {self.label!r}")
        if self.term not in TERMS:
            raise ValueError(f"unknown term form {self.term!r}")

    def fingerprint(self) -> str:
        """What has to be equal for two term sets to be comparable.

        The sample size is left out: an index and a query may use different
        sizes.
        """
        fields = asdict(self)
        fields.pop("size")
        if callable(self.hash_order):
            fields["hash_order"] = self.hash_order.__name__
        return json.dumps(fields, sort_keys=True)
