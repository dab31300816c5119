"""Options of a run, as ``key=value`` arguments or fields."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar

SEPARATORS = {"default": "\t", "tab": "\t", "comma": ",", "semicolon": ";", "space": " "}


@dataclass
class Options:
    """What to enumerate and by which plan.

    ``compressed`` asks for factorised results, ``count_only`` for counts;
    ``degree_prune`` drops vertices of degree 1 (no supported pattern has one);
    ``bloom`` leaves Spark's run-time Bloom filters on; ``partition_threshold``
    is the list length from which compressed lists are dealt in chunks (0: never);
    ``undirected`` says that the input lists each edge once, so none is looked
    for twice; ``hypergraph`` runs on the graph rebuilt from classes of twins;
    ``stages`` is a folder where squares, chordal squares and 4-cliques are kept
    and read again by later runs.
    """

    query: str = "square"
    input: str = ""
    output: str = ""
    separator: str = "default"
    undirected: bool = False
    clique_vertices: int = 4
    compressed: bool = True
    count_only: bool = True
    count_once: bool = True
    bloom: bool = True
    left_deep: bool = False
    non_overlapping: bool = False
    twin_twig: bool = False
    star: bool = False
    bottom_up: bool = False
    hypergraph: bool = False
    degree_prune: bool = True
    clique_threshold: int = 20
    partition_threshold: int = 0
    stages: str = ""
    sample_rate: float = 0.2
    sample_type: str = "vertex"
    seed: int = 42

    #: Spellings that launchers of comparable engines use.
    ALIASES: ClassVar[dict[str, str]] = {
        "enum.query": "query",
        "mapred.input.file": "input",
        "mapred.input.key.value.separator": "separator",
        "graph.undirected": "undirected",
        "clique.number.vertices": "clique_vertices",
        "result.compression": "compressed",
        "count.only": "count_only",
        "count.pattern.once": "count_once",
        "enable.bloom.filter": "bloom",
        "is.leftdeep": "left_deep",
        "is.nonoverlapping": "non_overlapping",
        "is.hypergraph": "hypergraph",
        "use.star": "star",
        "is.bottom.up": "bottom_up",
        "mapred.clique.size.threshold": "clique_threshold",
        "enum.house.square.partition.thresh": "partition_threshold",
        "enum.solarsquare.chordalsquare.partition.thresh": "partition_threshold",
        "graph.sample.rate": "sample_rate",
        "graph.sample.type": "sample_type",
    }

    @classmethod
    def parse(cls, args: list[str]) -> Options:
        """Options from ``key=value`` words; an unknown key is an error."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        got = {}
        for arg in args:
            key, eq, value = arg.partition("=")
            name = cls.ALIASES.get(key, key.replace("-", "_"))
            if not eq or name not in kinds:
                raise ValueError(f"unknown option: {arg}")
            kind = kinds[name]
            got[name] = value.strip().lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**got)

    @property
    def delimiter(self) -> str:
        return SEPARATORS.get(self.separator, self.separator)
