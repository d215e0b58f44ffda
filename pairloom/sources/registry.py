"""Benchmarks by name: where their files lie below a root, and their splits."""

from __future__ import annotations

# Splits by benchmark.
SPLITS = {
    "winoground": ["test"],
    "vsr": ["validation"],
    "countbench": ["test"],
    "mmvp": ["test"],
    "sugarcrepe": ["add_att", "add_obj", "replace_att", "replace_obj", "replace_rel", "swap_att", "swap_obj"],
    "spatialqa": ["coco_one", "coco_two", "vg_one", "vg_two"],
    "imagecode": ["valid"],
    "whatsup": ["a", "b"],
    "valse": ["existence", "plurals", "counting", "relations", "actions", "coreference", "noun phrases"],
    "pairs": ["object", "attribute", "relation", "counting"],
}


def splits(name: str) -> list[str]:
    """The splits of a benchmark; an unknown name is an error that lists the known ones."""
    if name not in SPLITS:
        raise KeyError(f"unknown benchmark {name}; known: {', '.join(sorted(SPLITS))}")
    return SPLITS[name]


def location(root: str, name: str, split: str) -> dict[str, str]:
    """Folders of pictures and annotations of a split."""
    if split not in splits(name):
        raise KeyError(f"{name} has no split {split}")
    return {"images": f"{root}/{name}/{split}/images", "annotations": f"{root}/{name}/{split}/annotations"}
