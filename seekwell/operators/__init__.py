from seekwell.operators.chunks import chunk_documents
from seekwell.operators.events import event_sessions, event_windows
from seekwell.operators.inverted import dictionary, inverted_index, postings
from seekwell.operators.texts import bm25_topk, context_pack, rank_fusion, rank_index, rank_texts
from seekwell.operators.vector_join import vector_join, vector_join_work
from seekwell.operators.vectors import knn_lsh, knn_topk

__all__ = [
    "bm25_topk",
    "chunk_documents",
    "context_pack",
    "dictionary",
    "event_sessions",
    "event_windows",
    "inverted_index",
    "knn_lsh",
    "knn_topk",
    "postings",
    "rank_fusion",
    "rank_index",
    "rank_texts",
    "vector_join",
    "vector_join_work",
]
