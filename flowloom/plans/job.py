"""Jobs: named steps over named flows, built into lazy DataFrames, with context, globals and child jobs."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.errors import ConfigurationError, JobAborted

#: Rows of context variables that come to the driver.
MOST_CONTEXT = 10_000

Operator = Callable[..., "dict[str, DataFrame] | DataFrame"]
_CASTS: dict[str, Callable[[str], Any]] = {"id_Integer": int, "id_Long": int, "int": int, "id_Double": float, "id_Float": float, "float": float, "id_Boolean": lambda s: s.lower() == "true", "bool": lambda s: s.lower() == "true"}


@dataclass
class Step:
    """One operator: input flows by `step.flow` (or the step alone for main), settings, and a condition on the globals for it to run."""

    name: str
    operator: Operator
    inputs: list[str] = field(default_factory=list)
    settings: dict[str, Any] = field(default_factory=dict)
    run_if: Callable[[dict[str, Any]], bool] | None = None


@dataclass
class Job:
    """Steps in order, with context variables that settings name as ${context.x} and globals that steps may read and set.

    Nothing runs before a sink or a count: a job's flows are Spark plans.
    """

    spark: SparkSession
    context: dict[str, Any] = field(default_factory=dict)
    globals: dict[str, Any] = field(default_factory=dict)
    flows: dict[str, DataFrame] = field(default_factory=dict)

    def resolved(self, value: Any) -> Any:
        if isinstance(value, str):
            whole = re.fullmatch(r"\$\{context\.(\w+)\}", value)
            return self.context[whole[1]] if whole else re.sub(r"\$\{context\.(\w+)\}", lambda m: str(self.context[m[1]]), value)
        if isinstance(value, dict):
            return {k: self.resolved(v) for k, v in value.items()}
        return [self.resolved(v) for v in value] if isinstance(value, list) else value

    def run(self, steps: list[Step]) -> dict[str, DataFrame]:
        for step in steps:
            if step.run_if and not step.run_if(self.globals):
                continue
            missing = [x for x in step.inputs if self._flow(x) not in self.flows]
            if missing:
                raise ConfigurationError(f"{step.name}: no flow {missing[0]!r}")
            made = step.operator(*[self.flows[self._flow(x)] for x in step.inputs], **self.resolved(step.settings))
            for flow, df in (made if isinstance(made, dict) else {"main": made}).items():
                self.flows[f"{step.name}.{flow}"] = df
        return self.flows

    @staticmethod
    def _flow(name: str) -> str:
        return name if "." in name else f"{name}.main"

    def count(self, flow: str) -> int:
        """A flow's rows, kept in the globals as step_NB_LINE or step_NB_LINE_FLOW."""
        step, _, name = self._flow(flow).partition(".")
        rows = self.flows[self._flow(flow)].count()
        self.globals[f"{step}_NB_LINE" + ("" if name == "main" else f"_{name.upper()}")] = rows
        return rows

    def load_context(self, df: DataFrame, new_keys: bool = True, name: str = "context", known_must_load: bool = False, most: int = MOST_CONTEXT) -> int:
        """Context variables from rows (key, value, perhaps type); the number of keys that were not there before.

        new_keys: whether such keys are taken. known_must_load: an error if the context
        has keys that the rows lack. The globals name_NB_CONTEXT_LOADED,
        name_KEY_NOT_INCONTEXT and name_KEY_NOT_LOADED have the keys that were set, and
        names of new and of lacking ones. More than `most` rows are an error.
        """
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ConfigurationError(f"more than {most} rows of context")
        known = set(self.context)
        named = {r["key"] for r in rows}
        lacking = sorted(known - named)
        if known_must_load and lacking:
            raise ConfigurationError(f"context keys without a row: {', '.join(lacking)}")
        for r in rows:
            if new_keys or r["key"] in known:
                cast = _CASTS.get(r["type"] if "type" in r.asDict() else "", lambda s: s)
                try:
                    self.context[r["key"]] = cast(r["value"])
                except (TypeError, ValueError):
                    self.context[r["key"]] = r["value"]
        loaded = named if new_keys else named & known
        self.globals |= {f"{name}_NB_CONTEXT_LOADED": len(loaded), f"{name}_KEY_NOT_INCONTEXT": ",".join(sorted(named - known)), f"{name}_KEY_NOT_LOADED": ",".join(lacking)}
        return sum(r["key"] not in known for r in rows)

    def set_global(self, key: str, value: Any = None, df: DataFrame | None = None, column: str | None = None, order_by: str | None = None) -> None:
        """A global from a value, or from a column of the last row by order_by."""
        self.globals[key] = df.agg(F.max_by(column, order_by)).first()[0] if df is not None else value

    def each_row(self, df: DataFrame, body: Callable[[Job, dict[str, Any]], None]) -> int:
        """body once for each row, taken one partition at a time."""
        count = 0
        for count, row in enumerate(df.toLocalIterator(), 1):
            body(self, row.asDict())
        return count

    def for_each(self, values: list[Any], body: Callable[[Job], None], name: str = "foreach") -> int:
        """body once for each value, which is in the globals name_CURRENT_VALUE, with its number from 1 in name_CURRENT_ITERATION."""
        for i, value in enumerate(values, 1):
            self.globals |= {f"{name}_CURRENT_VALUE": self.resolved(value), f"{name}_CURRENT_ITERATION": i}
            body(self)
        return len(values)

    def child(self, steps: list[Step], overrides: dict[str, Any] | None = None, depth: int = 0, most: int = 10) -> Job:
        """Another job in the same session with this one's context and some overrides."""
        if depth >= most:
            raise ConfigurationError("jobs nested too deep")
        job = Job(self.spark, {**self.context, **(overrides or {})})
        job.run(steps)
        return job

    def warn(self, message: str, code: int = 0, priority: int = logging.WARNING, name: str = "warn") -> None:
        """A message in the log and the globals; the job goes on."""
        message = self.resolved(message)
        self.globals |= {f"{name}_MESSAGE": message, f"{name}_CODE": code, f"{name}_PRIORITY": priority}
        logging.getLogger("flowloom").log(priority, "%s (%s)", message, code)

    def die(self, message: str, exit_code: int = 1) -> None:
        self.globals |= {"JOB_ERROR_MESSAGE": message, "JOB_EXIT_CODE": exit_code}
        raise JobAborted(message, exit_code)

    @staticmethod
    def pause(seconds: float) -> None:
        time.sleep(seconds)
