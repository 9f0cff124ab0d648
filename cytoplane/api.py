"""The public names."""

from .operators import cell_analysis, embeddings, neighbors  # noqa: F401  (they add their methods to SingleCell)
from .operators.cells import SingleCell
from .operators.concatenate import concat_obs, concat_var
from .operators.pseudobulk import DE, Pseudobulk
from .sources.storage import load, load_de, load_pseudobulk, ls, read_mtx, read_obs, read_obsm, read_obsp, read_uns, read_var, read_varm, read_varp, save_mtx

__all__ = ["DE", "Pseudobulk", "SingleCell", "concat_obs", "concat_var", "load", "load_de", "load_pseudobulk", "ls", "read_mtx", "read_obs", "read_obsm", "read_obsp", "read_uns", "read_var", "read_varm", "read_varp", "save_mtx"]
