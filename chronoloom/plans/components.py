"""Builders of scenes: components as nested values, checked and turned into rows.

A scene is rows of output_id, version, node_id, parent_id, child_ix,
component_id, type and props; :func:`rows` makes them from nested components.
"""

from __future__ import annotations

import json


class RequestError(ValueError):
    """A request that breaks a rule: a name taken or unknown, a value out of range."""


_PLACE = {"width", "height", "top", "left", "bottom", "right", "rotation", "transition"}
_BOX = {"border_radius", "border_width", "border_color", "box_shadow"}
#: What each kind may have, and what it must have.
KINDS: dict[str, tuple[set[str], set[str]]] = {
    "input_stream": ({"input_id"}, {"input_id"}),
    "view": (_PLACE | _BOX | {"direction", "overflow", "background_color", "padding", "padding_vertical", "padding_horizontal"}, set()),
    "web_view": ({"instance_id"}, {"instance_id"}),
    "shader": ({"shader_id", "shader_param", "resolution"}, {"shader_id", "resolution"}),
    "image": ({"image_id", "width", "height"}, {"image_id"}),
    "text": ({"text", "width", "height", "max_width", "max_height", "font_size", "line_height", "color", "font_family", "style", "align", "wrap", "weight", "background_color"}, {"text", "font_size"}),
    "tiles": ({"width", "height", "background_color", "tile_aspect_ratio", "margin", "padding", "horizontal_align", "vertical_align", "transition"}, set()),
    "rescaler": (_PLACE | _BOX | {"mode", "horizontal_align", "vertical_align"}, set()),
}
_MOST_CHILDREN = {"input_stream": 0, "image": 0, "text": 0, "rescaler": 1}
_CHOICES = {"direction": ("row", "column"), "overflow": ("visible", "hidden", "fit"), "mode": ("fit", "fill")}


def checked_volume(volume: float | None) -> float:
    volume = 1.0 if volume is None else volume
    if not 0 <= volume <= 2:
        raise RequestError("a volume is from 0 to 2")
    return volume


def checked_transition(duration_ms: float = 0.0, easing: str = "linear", points: tuple[float, ...] = (), should_interrupt: bool = False) -> dict:
    """A transition in nanoseconds; x controls of a curve lie between 0 and 1."""
    if not 0 <= duration_ms < 2**63 / 1e6:
        raise RequestError("a duration isn't negative")
    if easing not in ("linear", "bounce", "cubic_bezier"):
        raise RequestError(f"unknown easing {easing}")
    if easing == "cubic_bezier" and (len(points) != 4 or not (0 <= points[0] <= 1 and 0 <= points[2] <= 1)):
        raise RequestError("a curve has four controls, x1 and x2 from 0 to 1")
    return {"duration": round(duration_ms * 1e6), "kind": easing, "points": tuple(points), "interrupt": should_interrupt}


def component(kind: str, *children: dict, id: str | None = None, **props) -> dict:
    """One component with its children; unknown, missing or impossible properties are errors."""
    if kind not in KINDS:
        raise RequestError(f"unknown component {kind}")
    known, needed = KINDS[kind]
    if wrong := props.keys() - known:
        raise RequestError(f"{kind} has no {sorted(wrong)}")
    if missing := needed - props.keys():
        raise RequestError(f"{kind} needs {sorted(missing)}")
    if len(children) > _MOST_CHILDREN.get(kind, len(children)) or kind == "rescaler" and len(children) != 1:
        raise RequestError(f"{kind} can't have {len(children)} children")
    for a, b in (("top", "bottom"), ("left", "right")):
        if a in props and b in props:
            raise RequestError(f"{a} and {b} exclude each other")
    for name, values in _CHOICES.items():
        if name in props and props[name] not in values:
            raise RequestError(f"{name} is one of {values}")
    if "transition" in props:
        props = props | {"transition": checked_transition(**props["transition"])}
    return {"type": kind, "id": id, "props": props, "children": list(children)}


def rows(output_id: str, version: int, root: dict) -> list[dict]:
    """A row for each component, parents first; ids must be unique in a scene."""
    out: list[dict] = []
    ids: set[str] = set()
    waiting = [(root, None, 0)]
    while waiting:
        node, parent, ix = waiting.pop()
        if node["id"] is not None:
            if node["id"] in ids:
                raise RequestError(f"component {node['id']} is used twice")
            ids.add(node["id"])
        own = f"{parent}/{ix}" if parent else str(ix)
        out.append({"output_id": output_id, "version": version, "node_id": own, "parent_id": parent, "child_ix": ix, "component_id": node["id"], "type": node["type"], "props": json.dumps(node["props"], sort_keys=True)})
        waiting += [(c, own, i) for i, c in reversed(list(enumerate(node["children"])))]
    return out


SCHEMA = "output_id string, version int, node_id string, parent_id string, child_ix int, component_id string, type string, props string"


def view(output_id: str, node_id: str, parent_id: str | None = None, child_ix: int = 0, **place) -> dict:
    """A placed rectangle with its defaults, as :func:`scene.flatten` takes it."""
    base = {"top": 0.0, "left": 0.0, "width": 0.0, "height": 0.0, "scale_x": 1.0, "scale_y": 1.0, "rotation": 0.0, "border": 0.0, "mask": None}
    if unknown := place.keys() - base.keys():
        raise RequestError(f"unknown fields {sorted(unknown)}")
    return {"output_id": output_id, "node_id": node_id, "parent_id": parent_id, "child_ix": child_ix} | base | place
