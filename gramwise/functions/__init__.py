from gramwise.functions.parse import analyze, calories, portion, promotion, quantity
from gramwise.functions.text import canonical_name, choose_price, item_name, money, normalize, number, prices

__all__ = ["analyze", "calories", "canonical_name", "choose_price", "item_name", "money", "normalize", "number", "portion", "prices", "promotion", "quantity"]
