from seekwell.functions.planes import sign_planes
from seekwell.functions.text import bind, norm, term_counts, windows, words

__all__ = ["bind", "norm", "sign_planes", "term_counts", "windows", "words"]
