"""An extension: keeping index statistics over a stream of documents."""

from quillgraph.streaming.feed import postings_stream, term_counts

__all__ = ["postings_stream", "term_counts"]
