"""Fixed vocabularies: weakness families, severities, markers and noise lists.

The values are facts of the data model and must not be changed: results depend
on each of them."""

from __future__ import annotations

#: Parents of weakness classes.
PARENTS: dict[str, tuple[str, ...]] = {
    # memory
    "CWE-119": ("CWE-118",),
    "CWE-120": ("CWE-119", "CWE-118"),
    "CWE-121": ("CWE-119", "CWE-118"),
    "CWE-122": ("CWE-119", "CWE-118"),
    "CWE-123": ("CWE-119", "CWE-118"),
    "CWE-124": ("CWE-119", "CWE-118"),
    "CWE-125": ("CWE-119", "CWE-118"),
    "CWE-126": ("CWE-119", "CWE-118"),
    "CWE-127": ("CWE-119", "CWE-118"),
    "CWE-131": ("CWE-119", "CWE-118"),
    "CWE-787": ("CWE-119", "CWE-118"),
    "CWE-788": ("CWE-119", "CWE-118"),
    # integers
    "CWE-189": ("CWE-682",),
    "CWE-190": ("CWE-189", "CWE-682"),
    "CWE-191": ("CWE-189", "CWE-682"),
    "CWE-192": ("CWE-189", "CWE-682"),
    "CWE-194": ("CWE-189", "CWE-682"),
    "CWE-195": ("CWE-189", "CWE-682"),
    "CWE-196": ("CWE-189", "CWE-682"),
    "CWE-197": ("CWE-189", "CWE-682"),
    # commands and code
    "CWE-78": ("CWE-77", "CWE-74"),
    "CWE-77": ("CWE-74",),
    "CWE-94": ("CWE-74",),
    # format strings
    "CWE-134": ("CWE-668",),
    # use after free
    "CWE-415": ("CWE-416", "CWE-664", "CWE-404"),
    "CWE-416": ("CWE-415", "CWE-664", "CWE-404"),
    # null pointers
    "CWE-476": ("CWE-710",),
    # paths
    "CWE-22": ("CWE-23", "CWE-36", "CWE-59", "CWE-706"),
    "CWE-23": ("CWE-22", "CWE-706"),
    "CWE-36": ("CWE-22", "CWE-706"),
    # exposure
    "CWE-200": ("CWE-538", "CWE-668"),
    "CWE-532": ("CWE-200", "CWE-538"),
    "CWE-534": ("CWE-200", "CWE-538"),
    # access
    "CWE-284": ("CWE-285", "CWE-862", "CWE-863"),
    "CWE-285": ("CWE-284",),
    # resources
    "CWE-400": ("CWE-664",),
    "CWE-401": ("CWE-404", "CWE-664", "CWE-772"),
    "CWE-404": ("CWE-664",),
    "CWE-772": ("CWE-404", "CWE-664"),
    # cryptography
    "CWE-327": ("CWE-693", "CWE-311"),
    "CWE-328": ("CWE-327", "CWE-693"),
    "CWE-338": ("CWE-330", "CWE-693"),
}


def _number(name: str) -> int:
    return int(name.removeprefix("CWE-"))


def family(name: str) -> list[str]:
    """A class, its parents and theirs."""
    near = {name, *PARENTS.get(name, ())}
    return sorted(near | {q for p in near for q in PARENTS.get(p, ())}, key=_number)


def families() -> dict[str, list[str]]:
    """Every class that the hierarchy names, with its family."""
    named = set(PARENTS) | {p for ps in PARENTS.values() for p in ps}
    return {n: family(n) for n in sorted(named, key=_number)}


#: Severities in ascending order.
SEVERITIES = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Words in a path that mark a sample's label.
SAFE_MARKERS = ("good", "safe", "benign", "fixed")
VULNERABLE_MARKERS = ("vulnerable", "bad", "insecure", "unsafe")
#: Severities of one scanner that are no findings.
STYLE_SEVERITIES = ("information", "debug", "style", "performance", "portability")
#: Classes of sink categories.
SINK_CLASS = {
    "command_injection": "CWE-78",
    "code_injection": "CWE-94",
    "template_injection": "CWE-1336",
    "unsafe_deserialization": "CWE-502",
    "sql_injection": "CWE-89",
    "path_traversal": "CWE-22",
    "buffer_overflow": "CWE-120",
}
#: Classes that the taint engine models beside those of its sinks.
MODELLED_ALIASES = ("CWE-118", "CWE-119", "CWE-121", "CWE-122", "CWE-123", "CWE-124", "CWE-131", "CWE-787", "CWE-788")
#: Fixed value: 97.5th percentile of the standard normal.
Z95 = 1.959963984540054
STATUSES = ("CONFIRMED", "REJECTED", "UNCERTAIN")
#: The classes that the driver's tables are labelled with.
CLASSES = ("CWE-122", "CWE-190", "CWE-78", "CWE-89", "CWE-416", "CWE-476", "CWE-22", "CWE-502")
