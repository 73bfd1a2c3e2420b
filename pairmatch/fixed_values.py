"""Fixed values the results depend on: word lists, units, limits and text labels.

They are data, not logic. Every operator takes them as default arguments, so another
catalogue can bring its own.
"""

# Attribute keys that go first in an item text, by first fragment found in the key.
PRIORITY_FRAGMENTS = (
    "бренд",
    "brand",
    "производитель",
    "manufacturer",
    "артикул",
    "модель",
    "model",
    "mpn",
    "партномер",
    "код товара",
    "тип",
    "вид товара",
    "размер",
    "объем",
    "объём",
    "вес",
    "количество",
    "цвет",
)

# Identity groups and the key fragments that select them; the first group wins.
IDENTITY_GROUPS = {
    "brand": ("бренд", "brand", "производитель", "manufacturer"),
    "model": ("модель", "model", "mpn", "партномер", "part number"),
    "article": ("артикул", "article", "sku", "код товара"),
    "size": ("размер", "size", "диаметр", "длина", "ширина", "высота"),
    "volume": ("объем", "объём", "volume", "литраж", "емкость", "ёмкость"),
    "weight": ("вес", "weight", "масса"),
    "pack": ("количество", "упаков", "комплект", "набор", "шт", "pack"),
    "color": ("цвет", "color"),
}

# Words that stand for a unit when they are whole words.
UNIT_WORDS = {
    "ml": ("миллилитр", "миллилитра", "миллилитров", "мл", "ml"),
    "l": ("литр", "литра", "литров", "л", "l"),
    "kg": ("килограмм", "килограмма", "килограммов", "кг", "kg"),
    "g": ("грамм", "грамма", "граммов", "гр", "г", "g"),
    "mm": ("миллиметр", "миллиметра", "миллиметров", "мм", "mm"),
    "cm": ("сантиметр", "сантиметра", "сантиметров", "см", "cm"),
    "m": ("метр", "метра", "метров", "м", "m"),
    "pcs": ("штук", "штука", "штуки", "шт", "pc", "pcs"),
}

# Short forms that may follow a number directly.
ATTACHED_UNITS = {
    "ml": "ml", "мл": "ml", "l": "l", "л": "l",
    "kg": "kg", "кг": "kg", "g": "g", "гр": "g", "г": "g",
    "mm": "mm", "мм": "mm", "cm": "cm", "см": "cm", "m": "m", "м": "m",
    "pcs": "pcs", "шт": "pcs",
}

# Unit -> (base unit, factor).
BASE_UNITS = {
    "ml": ("ml", 1), "l": ("ml", 1000),
    "g": ("g", 1), "kg": ("g", 1000),
    "mm": ("mm", 1), "cm": ("mm", 10), "m": ("mm", 1000),
    "pcs": ("pcs", 1),
}

# Characters of a word in titles and comparison values, and of a title identifier.
WORD_CHARACTERS = "0-9a-zа-я"
IDENTIFIER_CHARACTERS = "0-9a-zа-я._/-"

# Budgets of the model texts, in characters, and the least length of a title identifier.
ATTRIBUTE_BUDGET = 4096
PROMPT_ATTRIBUTE_BUDGET = 1600
IDENTIFIER_MINIMUM = 3

# Labels of the item and pair texts.
ITEM_LABELS = ("категория: ", "название: ")
MISSING_MARK = "[MISSING]"

# Soft-label cut-offs, in ninths.
MAJORITY_NINTHS = 5
LOW_NINTHS = 2
HIGH_NINTHS = 7
