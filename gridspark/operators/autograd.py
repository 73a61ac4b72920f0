"""The graph of operations that results remember. No gradient is computed from it."""

from __future__ import annotations

import weakref
from abc import ABC, abstractmethod


class FunctionEdge(ABC):
    """An operation: its name, its inputs, the result it gave, and what it does forwards and backwards."""

    def __init__(self, inputs: tuple = (), output=None):
        self.inputs = tuple(inputs)
        self._output = (lambda: None) if output is None else weakref.ref(output)

    @property
    def output(self):
        """The result, if it is still held elsewhere; the graph alone doesn't keep it."""
        return self._output()

    @property
    @abstractmethod
    def name(self) -> str: ...

    @abstractmethod
    def forward(self): ...

    @abstractmethod
    def backward(self, gradient): ...


class AddEdge(FunctionEdge):
    """Addition. As in the operator set this follows, both directions do nothing."""

    @property
    def name(self) -> str:
        return "add"

    def forward(self):
        return None

    def backward(self, gradient):
        return None
