from quillgraph.plans.lineage import cut, written
from quillgraph.plans.sizes import bounded_broadcast, shuffled

__all__ = ["bounded_broadcast", "cut", "shuffled", "written"]
