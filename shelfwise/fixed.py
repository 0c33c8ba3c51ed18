"""Fixed values of the shop.

Everything here must equal the shop's own values for equal results: status
domains and column defaults, text widths, the statuses that count as a sale,
report windows, the delivery rule, message and line-text formats, upload
rules, request limits, the stock-ledger action and the seed rows.  Operators
import them from here.
"""

from __future__ import annotations

# Enum domains per table and column:
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "status"): ("active", "inactive", "blocked"),
    ("admins", "status"): ("active", "inactive"),
    ("categories", "status"): ("active", "inactive"),
    ("products", "status"): ("active", "inactive"),
    ("orders", "status"): ("pending", "confirmed", "shipped", "delivered", "cancelled"),
}
# Order statuses that count as a sale in KPIs and reports:
SALE_STATUSES = ("confirmed", "shipped", "delivered")
# Column defaults from the DDL:
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"is_verified": False, "status": "active"},
    "admins": {"role": "admin", "status": "active"},
    "categories": {"status": "active"},
    "products": {"stock": 0, "image_count": 0, "status": "active"},
    "product_images": {"is_primary": False, "sort_order": 0},
    "orders": {"status": "pending", "payment_method": "cash_on_delivery"},
    "user_addresses": {"is_default": False},
}
# Maximum text widths (VARCHAR(n)); TEXT columns are unbounded.
WIDTHS: dict[str, dict[str, int]] = {
    "users": {"name": 255, "email": 255, "password": 255, "reset_token": 255},
    "admins": {"name": 255, "email": 255, "password": 255, "role": 50},
    "categories": {"name": 100},
    "products": {"name": 255, "category": 100, "image_url": 500, "color": 100,
                 "material": 100, "size": 100},
    "product_images": {"image_url": 1000},
    "orders": {"payment_method": 50},
    "order_items": {"color": 100, "size": 100},
    "inventory_logs": {"action": 100},
    "activity_logs": {"action": 255, "ip_address": 45},
    "user_addresses": {"city": 100, "postal_code": 10},
}
# Report windows: daily report over the last 7 days, monthly over 12 months.
DAILY_WINDOW_DAYS = 7
MONTHLY_WINDOW_MONTHS = 12
# Delivery: free from a subtotal of 5000, otherwise a fee of 250.
FREE_DELIVERY_FROM = 5000
DELIVERY_FEE = 250
# Orders placed through the order endpoint: delivery address and payment method.
ORDER_DELIVERY_ADDRESS = "Pakistan"
ORDER_PAYMENT_METHOD = "cash_on_delivery"
# Stock ledger action written for each placed order line.
LEDGER_ACTION = "order_placed"
# Text formats: an order line, and the activity-log rows of status changes.
LINE_TEXT_FORMAT = "%s (Qty: %d) - Rs. %s"
ORDER_STATUS_ACTION = "Order %s status updated"
ORDER_STATUS_DETAILS = "New status: %s"
CUSTOMER_STATUS_ACTION = "Customer %s deactivated"
CUSTOMER_STATUS_DETAILS = "Status: %s"
# Upload rules: e-mail shape, image types, size and count limits, URL prefix.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ALLOWED_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
MAX_IMAGE_BYTES = 5 * 1024 * 1024
MAX_IMAGES_PER_UPLOAD = 5
UPLOAD_URL_PREFIX = "/uploads/"
# Per-minute request limits by route.
ROUTE_LIMITS = {"register": 5, "login": 10, "forgot_password": 3, "reset_password": 5,
                "admin_login": 5}
# Seed rows: five categories and ten products (name, description, category,
# category id, price, stock, colour, material, size), in insertion order.
SEED_CATEGORIES = [
    ("Primary School Bags", "Lightweight and colorful school bags for young children (Grade 1-5)"),
    ("Secondary School Bags", "Durable and spacious bags for middle and high school students (Grade 6-10)"),
    ("College & University Bags", "Stylish backpacks with laptop compartments for college and university students"),
    ("Trolley School Bags", "Wheeled trolley bags to reduce back strain for younger students"),
    ("Pencil Cases & Pouches", "Matching pencil cases, pouches and accessories for school"),
]
SEED_PRODUCTS = [
    ("Butterfly Kids School Bag", "Lightweight colorful bag with padded straps for young students", "Primary School Bags", 1, "1500.00", 60, "Pink", "Polyester", "Small"),
    ("Dino Adventure Primary Bag", "Fun dinosaur-themed bag perfect for nursery and KG students", "Primary School Bags", 1, "1200.00", 75, "Green", "Polyester", "Small"),
    ("Pro Student Backpack", "Spacious multi-compartment bag for secondary school students", "Secondary School Bags", 2, "2500.00", 50, "Blue", "Polyester", "Large"),
    ("Heavy Duty School Bag", "Extra-strong bag with reinforced base and padded back for daily use", "Secondary School Bags", 2, "3200.00", 40, "Black", "Oxford Fabric", "Large"),
    ("Campus Laptop Backpack", "Anti-theft backpack with USB charging port and 15.6\" laptop compartment", "College & University Bags", 3, "4500.00", 30, "Grey", "Canvas", "XL"),
    ("College Premium Bag", "Stylish backpack with organizer panel for college students", "College & University Bags", 3, "3800.00", 35, "Navy Blue", "Polyester", "Large"),
    ("Kids Trolley School Bag", "Easy-roll trolley bag that converts to backpack for primary students", "Trolley School Bags", 4, "2800.00", 25, "Red", "ABS & Polyester", "Medium"),
    ("Superhero Trolley Bag", "Superhero-themed trolley bag for boys with strong wheels", "Trolley School Bags", 4, "3000.00", 20, "Blue", "Polycarbonate", "Medium"),
    ("Zip Pencil Case Set", "Matching pencil case with pen holder and eraser pocket", "Pencil Cases & Pouches", 5, "350.00", 150, "Multi-color", "Nylon", "Small"),
    ("Large Stationery Pouch", "Wide capacity pouch for all stationery and art supplies", "Pencil Cases & Pouches", 5, "500.00", 100, "Black", "Canvas", "Medium"),
]


