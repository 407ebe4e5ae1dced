"""Table schemas, value sets, defaults and keys of the retail data model.

Money is DECIMAL(18,2) so sums are exact and do not depend on row order; timestamps are
TIMESTAMP_NTZ holding UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
_LONG, _STR, _BOOL, _TS = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


TABLES: dict[str, T.StructType] = {
    "users": _schema(
        id=_LONG, username=_STR, password_hash=_STR, role=_STR,
        question_1=_STR, answer_1=_STR, question_2=_STR, answer_2=_STR,
    ),
    "permissions": _schema(id=_LONG, permission=_STR),
    "role_permissions": _schema(id=_LONG, role=_STR, permission_id=_LONG),
    "user_permissions": _schema(id=_LONG, user_id=_LONG, permission_id=_LONG, granted=_BOOL),
    "categories": _schema(id=_LONG, category_name=_STR, description=_STR),
    "suppliers": _schema(
        id=_LONG, supplier_name=_STR, contact=_STR, phone=_STR, email=_STR, address=_STR,
    ),
    "products": _schema(
        id=_LONG, barcode=_STR, product_name=_STR, description=_STR, category_id=_LONG,
        supplier_id=_LONG, cost_price=MONEY, retail_price=MONEY, wholesale_price=MONEY,
        wholesale_min_qty=_LONG, stock=_LONG, min_stock=_LONG, unit=_STR, created_at=_TS,
        modified_at=_TS, active=_BOOL,
    ),
    "sales": _schema(
        id=_LONG, sold_at=_TS, user_id=_LONG, client_name=_STR, client_ident=_STR, total=MONEY,
        tendered=MONEY, change_due=MONEY, payment_type=_STR, status=_STR, notes=_STR,
    ),
    "sale_lines": _schema(
        id=_LONG, sale_id=_LONG, product_id=_LONG, quantity=_LONG, unit_price=MONEY,
        line_subtotal=MONEY, line_discount=MONEY,
    ),
}

# --- fixed values: these must equal the stored data, so they are kept word for word ---
ROLES = ("administrador", "empleado")
PAYMENT_TYPES = ("efectivo", "tarjeta_credito", "tarjeta_debito", "transferencia", "otro")
STATUSES = ("completada", "cancelada", "pendiente_pago", "en_proceso")
PERMISSIONS = (
    "gestionar_stock",
    "realizar_ventas",
    "generar_reportes_ventas",
    "administrar_usuarios",
    "modificar_configuracion_app",
    "exportar_datos_productos",
    "importar_datos_productos",
    "exportar_bd",
    "importar_bd",
    "ver_dashboard_ventas",
    "acceder_panel_administracion",
    "gestionar_inventario",
    "ver_inventario",
    "ajustar_stock",
    "gestionar_categorias",
    "gestionar_proveedores",
    "ver_precio_compra",
    "cancelar_ventas",
    "ver_historial_ventas_propias",
    "ver_historial_ventas_todas",
    "aplicar_descuentos_venta",
)
SELLER_PERMISSIONS = ("realizar_ventas", "ver_dashboard_ventas")
CASH = "efectivo"
COMPLETED = "completada"
STOCK_IN, STOCK_OUT = "entrada", "salida"
DEFAULT_UNIT = "unidad"

# Feed headers (source name -> column used inside the import).
FEED_COLUMNS = {
    "ID": "id",
    "Código Barras": "barcode",
    "Nombre Producto": "product_name",
    "Descripción": "description",
    "Categoría": "category",
    "Proveedor": "supplier",
    "Precio Compra": "cost_price",
    "Precio Venta": "retail_price",
    "Precio Mayoreo": "wholesale_price",
    "Cant. Mayoreo": "wholesale_min_qty",
    "Stock Actual": "stock",
    "Stock Mínimo": "min_stock",
    "Unidad Medida": "unit",
    "Activo": "active",
}
FEED_REQUIRED = ("Nombre Producto", "Código Barras", "Precio Venta")
FEED_TRUE = ("sí", "si", "true", "1", "yes")

# Catalogue export headers, in file order.
EXPORT_COLUMNS = {
    "ID": "id",
    "Código Barras": "barcode",
    "Nombre Producto": "product_name",
    "Descripción": "description",
    "Categoría ID": "category_id",
    "Categoría": "category_name",
    "Proveedor ID": "supplier_id",
    "Proveedor": "supplier_name",
    "Precio Compra ($)": "cost_price",
    "Precio Venta ($)": "retail_price",
    "Precio Mayoreo ($)": "wholesale_price",
    "Cant. Mayoreo": "wholesale_min_qty",
    "Stock Actual": "stock",
    "Stock Mínimo": "min_stock",
    "Unidad Medida": "unit",
    "Activo": "active",
    "Fecha Creación": "created_at",
    "Última Modificación": "modified_at",
}

# Import log.
CREATED, UPDATED, ERROR = "creado", "actualizado", "error"
IMPORT_MESSAGES = {
    CREATED: "product added",
    UPDATED: "product changed",
    "duplicate": "the barcode belongs to another product",
    "price_required": "a new product needs a sale price",
    "bad_number": "a price or a quantity is not a number",
    "bad_id": "the id is not a whole number",
}

# Texts in notes, report files and snapshot names.
MANUAL_NOTE = "AJUSTE MANUAL: "
REPORT_PERIOD = "ReporteVentasPeriodo"
REPORT_BY_USER = "VentasPorUsuario"
REPORT_TOP = "Top{n}Productos"
REPORT_CATALOGUE = "ListadoProductos"
SNAPSHOT = "pos_backup"
YES, NO, NOT_KNOWN = "Sí", "No", "N/A"

# capability -> groups of permissions: one of each group is needed
CAPABILITIES: dict[str, tuple[tuple[str, ...], ...]] = {
    "manage_users": (("administrar_usuarios",),),
    "edit_categories": (("gestionar_categorias", "gestionar_inventario"),),
    "edit_suppliers": (("gestionar_proveedores", "gestionar_inventario"),),
    "read_catalogue": (("ver_inventario", "gestionar_inventario"),),
    "edit_products": (("gestionar_inventario",),),
    "adjust_stock": (("ajustar_stock", "gestionar_inventario"),),
    "sell": (("realizar_ventas",),),
    "read_history": (("ver_historial_ventas_todas", "ver_historial_ventas_propias"),),
    "run_reports": (("generar_reportes_ventas",),),
    "run_user_report": (("generar_reportes_ventas",), ("ver_historial_ventas_todas",)),
    "export_snapshot": (("exportar_bd",),),
    "restore_snapshot": (("importar_bd",),),
    "export_products": (("exportar_datos_productos",),),
    "import_products": (("importar_datos_productos",),),
    "see_cost": (("ver_precio_compra", "gestionar_inventario"),),
}
# --- end of fixed values ---

REQUIRED: dict[str, tuple[str, ...]] = {
    "users": ("username", "password_hash", "role"),
    "permissions": ("permission",),
    "role_permissions": ("role", "permission_id"),
    "user_permissions": ("user_id", "permission_id", "granted"),
    "categories": ("category_name",),
    "suppliers": ("supplier_name",),
    "products": ("product_name", "cost_price", "retail_price", "stock"),
    "sales": ("user_id", "total"),
    "sale_lines": ("sale_id", "product_id", "quantity", "unit_price", "line_subtotal"),
}

UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("username",),),
    "permissions": (("permission",),),
    "role_permissions": (("role", "permission_id"),),
    "user_permissions": (("user_id", "permission_id"),),
    "categories": (("category_name",),),
    "suppliers": (("supplier_name", "phone"),),
    "products": (("barcode",),),
}

DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "users": {"role": ROLES},
    "sales": {"payment_type": PAYMENT_TYPES, "status": STATUSES},
}

# (child table, child column, parent table)
REFERENCES = (
    ("role_permissions", "permission_id", "permissions"),
    ("user_permissions", "user_id", "users"),
    ("user_permissions", "permission_id", "permissions"),
    ("products", "category_id", "categories"),
    ("products", "supplier_id", "suppliers"),
    ("sales", "user_id", "users"),
    ("sale_lines", "sale_id", "sales"),
    ("sale_lines", "product_id", "products"),
)

# "now" stands for the statement time, which callers pass in.
DEFAULTS: dict[str, dict[str, object]] = {
    "user_permissions": {"granted": True},
    "products": {
        "cost_price": 0, "stock": 0, "min_stock": 0, "unit": DEFAULT_UNIT,
        "created_at": "now", "active": True,
    },
    "sales": {"sold_at": "now", "status": COMPLETED},
    "sale_lines": {"line_discount": 0},
}
