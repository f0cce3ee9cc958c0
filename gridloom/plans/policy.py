"""Which backend and numerical policy answer a request, and with what provenance."""

from __future__ import annotations

from gridloom.model import require

# Names of the policies.
NATIVE = "native_grid_planar_fractional"
FRACTIONAL = "exactextract_fractional_v030"
RASTERIO = "exactextract_rasterio_v030"
POLICIES = (NATIVE, FRACTIONAL, RASTERIO)
LIMITS = {"zones": 512, "slices": 32, "bands": 64}
STRUCTURES = ("direct", "row_blocks", "hierarchy", "cumulative_full", "cumulative_blocked", "persistent_flat", "persistent_hierarchy")
FIVE = ("sum", "support", "mean", "min", "max")


def resolve(request: dict, prepared: bool = False) -> dict:
    """The provenance of a request: backend ``native``, ``exactextract`` or ``auto``; one policy, or several accepted ones.

    Both delegated policies run on this engine's own kernel. The fractional one measures normalised values; the other one measures
    raw samples, and refuses sources that are scaled or explicitly masked.
    """
    asked = request.get("backend", "native")
    require(asked in ("native", "exactextract", "auto"), "unknown backend")
    require(not ("numerical_policy" in request and "accepted_policies" in request), "numerical_policy and accepted_policies exclude each other")
    if "numerical_policy" in request:
        accepted = [request["numerical_policy"]]
    else:
        accepted = list(request.get("accepted_policies", [FRACTIONAL if asked == "exactextract" else NATIVE]))
    require(1 <= len(accepted) <= 3 and set(accepted) <= set(POLICIES), "one to three known policies are accepted")
    require(request.get("execution_envelope", "embedded_cooperative") == "embedded_cooperative", "only embedded_cooperative execution is available")
    native = asked == "native" or (asked == "auto" and NATIVE in accepted)
    policy = NATIVE if native else FRACTIONAL if FRACTIONAL in accepted else RASTERIO
    require(policy in accepted, "the backend conflicts with the accepted policy")
    require(native or not prepared, "a delegated policy cannot use summaries")
    require("backend_options" not in request or asked != "native", "backend_options do not apply to the native backend")
    return {
        "requested_backend": asked, "selected_backend": "native" if native else "exactextract", "numerical_policy": policy, "accepted_policies": accepted,
        "source_interpretation": "unscaled_raw" if policy == RASTERIO else "normalized_f64", "execution_envelope": "embedded_cooperative", "engine": "spark",
    }


def check_delegated(statistics: tuple[str, ...] | None, zones: int, slices: int, bands: int) -> None:
    require(statistics is None or set(statistics) <= set(FIVE), "delegated policies give sum, support, mean, min and max")
    require(zones <= LIMITS["zones"] and slices <= LIMITS["slices"] and bands <= LIMITS["bands"], "the request exceeds the delegated limits")
