"""Fixed values of the categorisation rules, in the order in which they apply."""

#: The first of these that a transaction's text contains decides its category.
MERCHANT_FIRST = {
    "mcdonald": "food and dining", "netflix.com": "entertainment", "spotify.com": "entertainment", "wal-mart": "shopping", "amzn": "shopping", "7-eleven": "food and dining",
    "7 eleven": "food and dining", "mcdonalds": "food and dining", "starbucks": "food and dining", "burger king": "food and dining", "wendys": "food and dining", "taco bell": "food and dining",
    "chipotle": "food and dining", "uber eats": "food and dining", "doordash": "food and dining", "grubhub": "food and dining", "shell oil": "transportation", "shell": "transportation",
    "bp": "transportation", "exxon": "transportation", "chevron": "transportation", "mobil": "transportation", "target": "shopping", "walmart": "shopping", "amazon": "shopping",
    "costco": "shopping", "best buy": "shopping", "cvs": "healthcare", "walgreens": "healthcare", "netflix": "entertainment", "spotify": "entertainment", "hulu": "entertainment",
    "disney": "entertainment", "mta": "transportation", "uber": "transportation", "lyft": "transportation", "taxi": "transportation", "hilton": "travel", "marriott": "travel",
    "airbnb": "travel", "booking.com": "travel", "delta": "travel", "united": "travel", "american airlines": "travel",
}

#: Keywords counted where no merchant rule applies; the order breaks ties.
KEYWORDS = {
    "transportation": ("gas", "fuel", "parking", "toll", "transit", "subway", "bus", "train"),
    "healthcare": ("pharmacy", "prescription", "doctor", "medical", "hospital", "clinic", "dental", "vision"),
    "food and dining": ("restaurant", "cafe", "coffee", "pizza", "sushi", "burger", "food"),
    "entertainment": ("movie", "theater", "cinema", "concert", "show", "streaming"),
    "utilities": ("electric", "water bill", "gas bill", "internet", "phone bill", "mobile"),
    "shopping": ("store", "retail", "mall", "outlet", "boutique"),
    "groceries": ("grocery", "supermarket", "produce", "organic"),
    "income": ("payroll", "salary", "deposit", "paycheck", "refund", "reimbursement"),
    "travel": ("hotel", "motel", "flight", "airline", "vacation", "resort"),
    "subscriptions": ("subscription", "membership", "saas", "software license"),
    "fees": ("late fee", "overdraft fee", "service fee", "atm fee", "monthly fee", "penalty"),
}

#: The default categories.
CATEGORIES = ("food and dining", "groceries", "shopping", "entertainment", "transportation", "healthcare", "utilities", "income", "transfer", "travel", "subscriptions", "fees")
