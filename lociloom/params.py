"""Parameters of a run, with the defaults and checks of the command line."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: Fixed values of the computation.
MIN_SV_SIZE = 50
MIN_MAPQ = 5
MIN_MAPQ_REMAP = 5
MAX_FETCH = 1_000_001
MIN_CLIP = 200
MAX_CONTIG_DEPTH = 100
MIN_DUP_OVERLAP = 0.9
MIN_DEPTH = 5
READ_TYPES = ("ont", "hifi", "clr")


@dataclass(frozen=True)
class Params:
    gaf: str = ""
    graph: str = ""
    fasta: str = ""
    sample: str = "sample"
    out: str = "out"
    phase: str | None = None
    support: int = 5
    dist: int = 100
    reads: str = "ont"
    threads: int = 16
    min_map_ratio: float = 0.90
    min_alignment_score: int = 5000
    precise_clipping: float = 0.97
    skip_untagged: bool = False
    no_remap: bool = False
    debug: bool = False
    assembler: str = "wtdbg2"
    remap_gaf: str | None = None
    asm: bool = False
    max_lines: int | None = None
    extra_dirs: tuple[str, ...] = field(default=())

    def checked(self) -> Params:
        """Itself if a run is possible with it, else ValueError. The asm preset takes every locus: support and dist are 0."""
        for name in ("gaf", "graph", "fasta"):
            if not getattr(self, name):
                raise ValueError(f"--{name} is required")
        for name in ("gaf", "graph", "fasta", "phase"):
            path = getattr(self, name)
            if path and "://" not in path and not Path(path).exists():
                raise ValueError(f"--{name}: no such file: {path}")
        if self.reads not in READ_TYPES:
            raise ValueError(f"--reads must be one of {', '.join(READ_TYPES)}")
        if self.support < 0 or self.dist < 0 or self.threads < 1:
            raise ValueError("--support and --dist must not be negative, --threads at least 1")
        if self.asm:
            from dataclasses import replace

            return replace(self, support=0, dist=0, asm=False)
        return self
