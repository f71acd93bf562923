"""Parts of scoring plans by name, with the contracts that a plan checks before it reads a voxel."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, Generic, TypeVar

P = TypeVar("P", bound="Part")
#: What can be scored, and what predictions hold.
FORMS = ("instances", "classes")
KINDS = ("affinities", "scores", *FORMS)


class Part:
    """A named part; its settings are the named parameters of its ``__init__``, and no others."""

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        own = cls.__init__

        def checked(self: Part, *args: Any, **settings: Any) -> None:
            known = [p.name for p in list(inspect.signature(own).parameters.values())[1:] if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)]
            if unknown := sorted(settings.keys() - set(known)):
                raise ValueError(f"{type(self).__name__} has no settings {unknown}; it takes {known}")
            own(self, *args, **settings)

        if "__init__" in cls.__dict__:
            cls.__init__ = checked


class Registry(Generic[P]):
    """Parts of one contract by name: a name is given once, and an unknown one is refused with those there are."""

    def __init__(self, contract: type[P]):
        self.contract, self.parts = contract, {}

    def register(self, name: str) -> Callable[[type[P]], type[P]]:
        def put(part: type[P]) -> type[P]:
            if name in self.parts:
                raise ValueError(f"{name!r} is registered already")
            if not (isinstance(part, type) and issubclass(part, self.contract)):
                raise TypeError(f"{part!r} is no {self.contract.__name__}")
            part.contract()
            self.parts[name] = part
            return part

        return put

    def names(self) -> list[str]:
        return sorted(self.parts)

    def build(self, name: str, **settings: Any) -> P:
        if name not in self.parts:
            raise KeyError(f"unknown {name!r}; there are {self.names()}")
        return self.parts[name](**settings)
