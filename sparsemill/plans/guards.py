"""Checks of a data set's state before a plan is built."""

from __future__ import annotations


class StateError(ValueError):
    """A state that a plan may not start from; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def require_raw_counts(state: dict | None) -> None:
    """Raise unless the data set holds raw counts that nothing has processed. The first reason in this order is given."""
    if state is None:
        raise StateError("invalid_argument", "the state is missing")
    if state.get("preprocess_available"):
        raise StateError("already_preprocessed", "preprocessing results are already stored")
    if not state.get("raw_counts_available"):
        raise StateError("not_raw_counts", "there are no raw counts")
    if state.get("processed_matrix_available"):
        raise StateError("not_raw_counts", "the active matrix is processed")
    if state.get("matrix_state") not in (None, "raw_counts"):
        raise StateError("not_raw_counts", f"the matrix state is {state['matrix_state']}")


def reject_second_run(state: dict | None) -> None:
    if state is None:
        raise StateError("invalid_argument", "the state is missing")
    if state.get("preprocess_available"):
        raise StateError("already_preprocessed", "preprocessing results are already stored")


def stage_plan(source_format: str, matrix: str, allow_processed: bool = False) -> dict:
    """How a source is staged: sparse blocks of half-precision values, single-precision sums, read through the store."""
    if source_format not in ("h5ad", "mtx"):
        raise StateError("unsupported_layout", f"cannot read {source_format}")
    if not allow_processed and matrix not in ("raw", "counts"):
        raise StateError("not_raw_counts", f"{matrix} is not a raw or count matrix")
    return {"layout": "blocked_ell", "value_type": "f16", "accumulator_type": "f32", "through_store": True, "direct_kernels": False}


def same_identity(left: dict, right: dict, *keys: str) -> None:
    """Axis, order or domain identities must agree before two tables are joined."""
    for k in keys:
        if left.get(k) != right.get(k):
            raise StateError("identity_mismatch", f"{k}: {left.get(k)} and {right.get(k)}")


def current_generation(structure: dict, values: dict) -> None:
    """A value table belongs to one structure, and its epoch and generation may not be behind."""
    same_identity(structure, values, "structure_id", "epoch")
    if values.get("generation", 0) < structure.get("required_generation", 0):
        raise StateError("stale_values", f"generation {values.get('generation')} is behind {structure['required_generation']}")


class Registry:
    """Interned identities: the same name has one handle until its last holder releases it."""

    def __init__(self, most: int = 256):
        self.most, self._handles, self._holders, self._next = most, {}, {}, 1

    def intern(self, name: str) -> int:
        if name not in self._handles:
            if len(self._handles) >= self.most:
                raise StateError("registry_full", f"{self.most} identities are in use")
            self._handles[name], self._next = self._next, self._next + 1
            self._holders[name] = 0
        self._holders[name] += 1
        return self._handles[name]

    def resolve(self, handle: int) -> str:
        for name, h in self._handles.items():
            if h == handle:
                return name
        raise StateError("unknown_handle", f"{handle} is not in use")

    def release(self, name: str) -> None:
        if name not in self._handles:
            raise StateError("unknown_handle", f"{name} is not in use")
        self._holders[name] -= 1
        if not self._holders[name]:
            del self._handles[name], self._holders[name]
