"""Replayable lists of table methods and of read-processing steps."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from ..operators import reads as read_steps
from ..table import CountTable, DETable, FeatureTable, FoldChangeTable

TABLE_TYPES = {t.__name__: t for t in (FeatureTable, CountTable, DETable, FoldChangeTable)}
KEEPS_TABLE = ("filter", "normalize", "sort", "translate")


class Pipeline:
    """Named methods with their arguments, applied in order.

    Filters, normalisations, sorts and translations replace the table; methods that start with ``split`` fan out into
    tuples; everything else goes to a dictionary of outputs and leaves the table as it is.
    """

    def __init__(self, table_type: type[FeatureTable] | str = FeatureTable):
        self.table_type = TABLE_TYPES[table_type] if isinstance(table_type, str) else table_type
        self.steps: list[tuple[str, list, dict]] = []

    def __len__(self) -> int:
        return len(self.steps)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Pipeline) and (self.table_type, self.steps) == (other.table_type, other.steps)

    def add_function(self, function: str | Callable, *args: Any, **kwargs: Any) -> Pipeline:
        name = function if isinstance(function, str) else function.__name__
        if name.startswith("_") or not callable(getattr(self.table_type, name, None)):
            raise AttributeError(f"{self.table_type.__name__} has no method {name!r}")
        self.steps.append((name, list(args), kwargs))
        return self

    def remove_last_function(self) -> Pipeline:
        if not self.steps:
            raise IndexError("the pipeline is empty")
        self.steps.pop()
        return self

    def apply_to(self, table: FeatureTable) -> Any:
        """The final table (or nested tuples of tables after splits); with outputs, a pair (table, outputs)."""
        if not self.steps:
            raise ValueError("the pipeline is empty")
        outputs: dict[str, Any] = {}
        current: Any = table
        for name, args, kwargs in self.steps:
            if any(word in name for word in KEEPS_TABLE):
                current = self._each(current, lambda t: getattr(t, name)(*args, **kwargs))
                current = self._take_factors(current, name, outputs)
            elif name.startswith("split"):
                current = self._each(current, lambda t: self._parts(getattr(t, name)(*args, **kwargs)))
            else:
                label = f"{name}_{1 + sum(k.startswith(name + '_') for k in outputs)}"
                outputs[label] = self._each(current, lambda t: getattr(t, name)(*args, **kwargs))
        return (current, outputs) if outputs else current

    def _take_factors(self, current: Any, name: str, outputs: dict[str, Any]) -> Any:
        """Scaling factors returned next to a table move to the outputs."""
        if isinstance(current, tuple) and len(current) == 2 and not hasattr(current[1], "key") and hasattr(current[0], "key") \
                and hasattr(current[1], "schema"):
            outputs[f"{name}_factors"] = current[1]
            return current[0]
        return current

    @staticmethod
    def _parts(result: Any) -> Any:
        if isinstance(result, dict):
            return tuple(result.values())
        if isinstance(result, CountTable) and "cluster" in result.df.columns:
            return tuple(result.parts().values())
        return result

    def _each(self, current: Any, fn: Callable[[FeatureTable], Any]) -> Any:
        return tuple(self._each(c, fn) for c in current) if isinstance(current, tuple) else fn(current)

    # --- files: a JSON document, which every YAML reader accepts too
    def to_dict(self) -> dict:
        return {"filter_type": self.table_type.__name__, "functions": [s[0] for s in self.steps],
                "params": [[s[1], s[2]] for s in self.steps]}

    def export_pipeline(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), indent=2)
        if path:
            with open(path, "w") as f:
                f.write(text)
        return text

    @classmethod
    def import_pipeline(cls, source: str | dict) -> Pipeline:
        """From a dictionary, JSON text or a file; YAML files need the optional ``yaml`` package."""
        if isinstance(source, str):
            text = source
            if not source.lstrip().startswith("{"):
                with open(source) as f:
                    text = f.read()
            try:
                source = json.loads(text)
            except json.JSONDecodeError:
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError("this file is YAML; install a YAML reader or export it as JSON") from e
                source = yaml.safe_load(text)
        out = cls(source["filter_type"])
        for name, (args, kwargs) in zip(source["functions"], source["params"], strict=True):
            out.add_function(name, *args, **kwargs)
        return out


class ReadPipeline:
    """A chain of read steps, each DataFrame -> DataFrame, for single reads or mate pairs."""

    STEPS = {f.__name__: f for f in (read_steps.trim_quality, read_steps.trim_n, read_steps.trim_adapters, read_steps.filter_length,
                                     read_steps.trim_single_end, read_steps.trim_paired_end, read_steps.find_duplicates,
                                     read_steps.sort_alignments, read_steps.validate_alignments, read_steps.count_features)}

    def __init__(self) -> None:
        self.steps: list[tuple[str, dict]] = []

    def add_function(self, name: str, **kwargs: Any) -> ReadPipeline:
        if name not in self.STEPS:
            raise AttributeError(f"unknown read step {name!r}")
        self.steps.append((name, kwargs))
        return self

    def apply_to(self, *inputs: Any) -> tuple[Any, list[Any]]:
        """Runs the steps on one DataFrame (or two mates for a leading paired step): (final, side results)."""
        current: Sequence[Any] = inputs
        side = []
        for name, kwargs in self.steps:
            result = self.STEPS[name](*current, **kwargs)
            if name in ("validate_alignments", "count_features"):
                side.append(result)
            else:
                current = (result,)
        return (current[0] if len(current) == 1 else tuple(current)), side
