"""Key, button and scroll names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw key name -> display name.
KEY_NAMES = {
    "Return": "Return",
    "Escape": "Escape",
    "Backspace": "Backspace",
    "Space": "Space",
    "Tab": "Tab",
    "ShiftLeft": "Shift",
    "ShiftRight": "Shift",
    "ControlLeft": "Ctrl",
    "ControlRight": "Ctrl",
    "Alt": "Alt",
    "AltLeft": "Alt",
    "AltRight": "Alt",
    "AltGr": "AltGr",
    "MetaLeft": "Cmd",
    "MetaRight": "Cmd",
    "UpArrow": "UpArrow",
    "DownArrow": "DownArrow",
    "LeftArrow": "LeftArrow",
    "RightArrow": "RightArrow",
    "CapsLock": "CapsLock",
    "Delete": "Delete",
    "Home": "Home",
    "End": "End",
    "PageUp": "PageUp",
    "PageDown": "PageDown",
}

# Keys that modify others, and the order in which a combination shows them.
MODIFIERS = ("Shift", "Ctrl", "Alt", "AltGr", "Cmd")
SHOWN_MODIFIERS = ("Cmd", "Ctrl", "Alt", "Shift")

# Spellings used in training text.
TRAINING_RENAMES = {
    "SemiColon": "Semicolon",
    "BackSlash": "Backslash",
    "BackQuote": "Backtick",
}

# Lower-case spellings accepted in predictions.
PREDICTION_ALIASES = {
    "enter": "Return",
    "return": "Return",
    "esc": "Escape",
    "escape": "Escape",
    "backspace": "Backspace",
    "delete": "Delete",
    "space": "Space",
    "tab": "Tab",
    "capslock": "CapsLock",
    "uparrow": "UpArrow",
    "up": "UpArrow",
    "downarrow": "DownArrow",
    "down": "DownArrow",
    "leftarrow": "LeftArrow",
    "left": "LeftArrow",
    "rightarrow": "RightArrow",
    "right": "RightArrow",
    "cmd": "Cmd",
    "command": "Cmd",
    "meta": "Cmd",
    "ctrl": "Ctrl",
    "control": "Ctrl",
    "alt": "Alt",
    "option": "Alt",
    "shift": "Shift",
    "home": "Home",
    "end": "End",
    "pageup": "PageUp",
    "pagedown": "PageDown",
}

# Mouse buttons, action types, and the named selections of action types.
BUTTONS = ("Left", "Right", "Middle")
ACTION_TYPES = ("KeyPress", "MouseClick", "MouseScroll")
ACTION_TYPE_PRESETS = {
    "keyboard": ("KeyPress",),
    "keyboard,click": ("KeyPress", "MouseClick"),
    "keyboard,click,scroll": ACTION_TYPES,
    "all": ACTION_TYPES,
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{raw}', '{name}'" for raw, name in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def normalize_key(raw: Column) -> Column:
    """Display name of a raw key: mapped, or the bare letter or digit, or unchanged."""
    letter = raw.startswith("Key") & (F.length(raw) == 4)
    digit = raw.startswith("Digit") & (F.length(raw) == 6)
    return F.coalesce(
        _lookup(KEY_NAMES, raw),
        F.when(letter, F.upper(F.substring(raw, 4, 1))),
        F.when(digit, F.substring(raw, 6, 1)),
        raw,
    )


def is_modifier(key: Column) -> Column:
    return key.isin(*MODIFIERS)


def format_combo(key: Column, held: dict[str, Column]) -> Column:
    """``Cmd+Shift+A``: the held modifiers in display order, then the key."""
    shown = [F.when(held[m], F.lit(m)) for m in SHOWN_MODIFIERS if m in held]
    return F.when(is_modifier(key), key).otherwise(F.concat_ws("+", *shown, key))


def payload_key(payload: Column) -> Column:
    """Key name in a ``[code, name]`` payload; null where the entry is to be ignored."""
    name = F.get(payload, F.lit(1))
    return F.when(name != "UNKNOWN", name)


def valid_button(button: Column) -> Column:
    return F.when(button.isin(*BUTTONS), button)


def payload_button(payload: Column) -> Column:
    return valid_button(F.get(payload, F.lit(0)))


def scroll_delta(dx: Column, dy: Column) -> Column:
    """Vertical movement, or the horizontal one where there is none; null if neither, and where
    one of them is not a number."""
    both = dx.isNotNull() & dy.isNotNull()
    return F.when(both, F.coalesce(F.nullif(dy, F.lit(0.0)), F.nullif(dx, F.lit(0.0))))


def scroll_direction(amount: Column) -> Column:
    return F.when(amount < 0, "down").when(amount > 0, "up")


def normalize_training_details(details: Column) -> Column:
    """Apply the training spellings to each part of a combination."""
    return F.array_join(
        F.transform(
            F.split(details, r"\+", -1),
            lambda part: F.coalesce(_lookup(TRAINING_RENAMES, part), part),
        ),
        "+",
    )


def normalize_pred_key(details: Column) -> Column:
    """Spell a predicted key the way truth spells it, part by part."""

    def spell(part: Column) -> Column:
        return F.coalesce(
            _lookup(PREDICTION_ALIASES, F.lower(part)),
            F.when(part.rlike(r"^\p{L}$"), F.upper(part)),
            part,
        )

    return F.array_join(
        F.transform(F.split(details, r"\+", -1), lambda part: spell(F.regexp_replace(part, r"^\s+|\s+$", ""))), "+"
    )


def selected_types(preset: str) -> tuple[str, ...]:
    if preset not in ACTION_TYPE_PRESETS:
        raise ValueError(
            f"unknown action types {preset!r}; one of {sorted(ACTION_TYPE_PRESETS)}"
        )
    return ACTION_TYPE_PRESETS[preset]
