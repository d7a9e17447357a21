"""A chain of nested selections over a frame.

Each step narrows the one before it.  Steps are immutable, so going back to an
ancestor costs nothing and branches share what they have in common; Catalyst
merges the predicates of a chain into one filter.  A step counts as complete
only after its records were counted without a failure; what depends on an
incomplete step is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from .frames import Frame, col
from .search import OrdinalRange, SearchQuery, TimeRange


class Incomplete(RuntimeError):
    """A step of the chain was cancelled or failed."""


@dataclass(frozen=True)
class Selection:
    """A node of the chain; the root has no step."""

    frame: Frame
    parent: Selection | None = None
    step: SearchQuery | TimeRange | OrdinalRange | None = None
    state: dict = field(default_factory=lambda: {"status": "pending", "matches": None}, compare=False)

    @classmethod
    def all(cls, frame: Frame) -> Selection:
        return cls(frame, state={"status": "complete", "matches": None})

    def narrow(self, step: SearchQuery | TimeRange | OrdinalRange) -> Selection:
        self.require()
        if isinstance(step, SearchQuery) and step.columns:
            for name in step.columns:
                if self.frame.resolve(name) in self.frame.derived and not self.frame.options.get("search_derived"):
                    raise ValueError(f"{name!r} is a derived column; it is counted, not searched")
        return Selection(self.frame.where(step.predicate(self.frame)), self, step)

    def pivot(self, column: str, value: str) -> Selection:
        """The records whose column holds exactly this value."""
        return self.narrow(SearchQuery(value, "exact", columns=(column,)))

    def count(self) -> int:
        """Counts the records, which completes the step; a failure marks it."""
        if self.state["matches"] is None:
            try:
                self.state["matches"] = self.frame.df.count()
            except BaseException:
                self.state["status"] = "failed"
                raise
            self.state["status"] = "complete"
        return self.state["matches"]

    def keep(self) -> Selection:
        """The same selection with its records kept by the executors, for a front end that pages through them; ``forget`` lets them go."""
        return replace(self, frame=self.frame.with_df(self.frame.df.persist()))

    def forget(self) -> None:
        self.frame.df.unpersist()

    def cancel(self) -> None:
        if self.state["status"] == "pending":
            self.state["status"] = "cancelled"

    def chain(self) -> list[Selection]:
        """From the root to this node."""
        out: list[Selection] = []
        node: Selection | None = self
        while node:
            out.append(node)
            node = node.parent
        return out[::-1]

    def __iter__(self) -> Iterator[Selection]:
        return iter(self.chain())

    def require(self) -> None:
        """Raises unless no step up to here was cancelled or failed."""
        for node in self.chain():
            if node.state["status"] in ("cancelled", "failed"):
                raise Incomplete(f"the step {node.step} was {node.state['status']}: its records are not all known")

    def complete(self) -> None:
        """Counts every step that was not, and raises for those that can't be."""
        self.require()
        for node in self.chain()[1:]:
            node.count()

    def back(self, steps: int = 1) -> Selection:
        chain = self.chain()
        return chain[max(0, len(chain) - 1 - steps)]

    def revert_to(self, depth: int) -> Selection:
        """The ancestor after so many steps."""
        return self.chain()[depth]

    def clear(self) -> Selection:
        return self.chain()[0]

    def operations(self) -> list[dict]:
        """The steps as a manifest records them; all have to be complete."""
        self.complete()
        out = []
        for node in self.chain()[1:]:
            if isinstance(node.step, SearchQuery):
                out.append({"op": "search", "query": node.step.manifest(node.parent.frame), "matches": node.count()})
            elif isinstance(node.step, TimeRange):
                out.append({"op": "time_range", **node.step.manifest(node.parent.frame), "matches": node.count()})
        return out

    def description(self) -> dict:
        """What was selected, as a manifest records it."""
        if not self.parent:
            return {"kind": "all"}
        if isinstance(self.step, OrdinalRange) and not self.parent.parent:
            return {"kind": "range", "first": self.step.first, "count": self.count()}
        return {"kind": "matches", "records": self.count()}

    def values(self, name: str):
        return self.frame.df.select(col(name))


def intersect(a: Selection, b: Selection) -> Frame:
    """Records of both selections; on chains of one root this is a semi join on the ordinal."""
    return a.frame.with_df(a.frame.df.join(b.frame.df.select("_ordinal"), "_ordinal", "left_semi"))


def complement(whole: Frame, part: Frame) -> Frame:
    """Records of ``whole`` that are not in ``part``."""
    return whole.with_df(whole.df.join(part.df.select("_ordinal"), "_ordinal", "left_anti"))
