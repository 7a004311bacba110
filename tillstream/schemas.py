"""Declared schemas of the raw entities.

Times arrive as ISO text. The five amounts the cleaning step coerces are declared as
text in the event schema, so unreadable values reach that step instead of becoming
null in the reader.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# Field names and types of the input files.
_DDL = {
    "cart_events": """
        event_id STRING, event_type STRING, timestamp STRING, timestamp_unix BIGINT, session_id STRING,
        customer_id BIGINT, is_guest BOOLEAN, source STRING, device STRING, browser STRING,
        ip_address STRING, user_agent STRING, page_url STRING, referrer STRING,
        utm_source STRING, utm_medium STRING, utm_campaign STRING,
        product_id BIGINT, product_name STRING, product_sku STRING, product_category STRING,
        product_brand STRING, product_price_vnd STRING, product_price_usd STRING,
        quantity STRING, old_quantity BIGINT, line_total_vnd STRING, line_total_usd STRING,
        view_duration_seconds BIGINT, order_id STRING, total_amount_vnd BIGINT, total_amount_usd DOUBLE,
        item_count BIGINT, payment_method STRING, shipping_method STRING,
        scroll_depth_percent BIGINT, page_height BIGINT, scroll_position BIGINT,
        time_on_page_seconds BIGINT, exit_type STRING, search_query STRING, results_count BIGINT,
        search_type STRING, cart_value_vnd BIGINT, cart_value_usd DOUBLE, shipping_cost_vnd BIGINT,
        estimated_delivery_days BIGINT, save_payment_info BOOLEAN, failure_reason STRING,
        attempted_amount_vnd BIGINT, cancelled_by STRING, cancellation_reason STRING, order_value_vnd BIGINT
    """,
    "products": """
        id BIGINT, name STRING, name_en STRING, sku STRING, barcode STRING, category STRING, brand STRING,
        model STRING, price_vnd BIGINT, price_usd DOUBLE, cost_vnd BIGINT, cost_usd DOUBLE,
        currency_primary STRING, warranty_months BIGINT, stock_quantity BIGINT, description_vi STRING,
        description_en STRING, weight_kg DOUBLE, created_at STRING, updated_at STRING
    """,
    "customers": """
        id BIGINT, full_name STRING, first_name STRING, last_name STRING, email STRING, phone STRING,
        city STRING, country STRING, is_vietnamese BOOLEAN, language STRING, created_at STRING,
        total_orders BIGINT, total_spent_vnd BIGINT, total_spent_usd BIGINT
    """,
    "staff": """
        id BIGINT, code STRING, full_name STRING, email STRING, phone STRING, position STRING,
        hire_date STRING, status STRING
    """,
    "locations": """
        id BIGINT, tenant_id BIGINT, name STRING, code STRING, address STRING, district STRING, city STRING,
        country STRING, phone STRING, email STRING, status STRING, created_on STRING, modified_on STRING,
        latitude STRING, longitude STRING
    """,
    "shops": """
        id BIGINT, company_id BIGINT, name STRING, company_name STRING, currency_code STRING,
        warehouse_name STRING, city STRING, country STRING, create_date STRING, write_date STRING,
        pricelist_id BIGINT, currency_id BIGINT, warehouse_id BIGINT, picking_type_id BIGINT,
        journal_id BIGINT, module_pos_discount BOOLEAN
    """,
    "online_orders": """
        order_id STRING, transaction_id STRING, customer_id BIGINT, channel STRING, channel_name STRING,
        channel_order_id STRING, created_at STRING, updated_at STRING, confirmed_at STRING, status STRING,
        status_name STRING, status_history ARRAY<STRUCT<status: STRING, timestamp: STRING, note: STRING>>,
        customer_name STRING, customer_email STRING, customer_phone STRING,
        shipping_address STRUCT<full_name: STRING, phone: STRING, address: STRING, ward: STRING,
            district: STRING, city: STRING, country: STRING, postal_code: STRING>,
        line_items ARRAY<STRUCT<line_id: STRING, product_id: BIGINT, product_name: STRING,
            product_sku: STRING, product_category: STRING, quantity: BIGINT, unit_price: BIGINT,
            discount_percent: BIGINT, discount_amount: BIGINT, line_total: BIGINT, weight_kg: DOUBLE>>,
        item_count BIGINT, total_quantity BIGINT, subtotal BIGINT, tax_amount BIGINT, shipping_fee BIGINT,
        discount_total BIGINT, total BIGINT, currency STRING, payment_method STRING,
        payment_method_name STRING, payment_status STRING, shipping_method STRING,
        shipping_method_name STRING,
        tracking STRUCT<carrier: STRING, tracking_number: STRING, shipped_at: STRING,
            estimated_delivery: STRING, tracking_url: STRING>,
        total_weight_kg DOUBLE, customer_note STRING, internal_note STRING, source STRING,
        utm_source STRING, utm_medium STRING, utm_campaign STRING
    """,
    "shopify_orders": """
        id BIGINT, order_number STRING, customer_id BIGINT, customer_name STRING, customer_email STRING,
        transaction_id STRING, order_date STRING, updated_at STRING, payment_gateway STRING,
        payment_status STRING, fulfillment_status STRING, currency STRING, subtotal_vnd BIGINT,
        subtotal_usd DOUBLE, tax_vnd BIGINT, tax_usd DOUBLE, shipping_vnd BIGINT, shipping_usd DOUBLE,
        total_vnd BIGINT, total_usd DOUBLE,
        line_items ARRAY<STRUCT<id: BIGINT, product_id: BIGINT, product_name: STRING, sku: STRING,
            quantity: BIGINT, price_vnd: BIGINT, price_usd: DOUBLE, transaction_id: STRING>>,
        channel STRING, source STRING
    """,
    "sapo_orders": """
        id BIGINT, tenant_id BIGINT, code STRING, order_code STRING, location_id BIGINT,
        location_name STRING, location_code STRING, transaction_id STRING, created_on STRING,
        modified_on STRING, finished_on STRING, status STRING, source STRING, channel STRING,
        customer STRUCT<id: BIGINT, name: STRING, phone: STRING>,
        staff STRUCT<id: BIGINT, code: STRING, full_name: STRING, position: STRING>,
        line_items ARRAY<STRUCT<id: BIGINT, product_id: BIGINT, variant_id: BIGINT, sku: STRING,
            barcode: STRING, product_name: STRING, quantity: BIGINT, price_vnd: BIGINT,
            discount_percent: BIGINT, discount_amount: BIGINT, line_amount: BIGINT, transaction_id: STRING>>,
        total_before_discount BIGINT, total_discount BIGINT, total_before_vat BIGINT, vat_rate DOUBLE,
        vat_amount BIGINT, total_vnd BIGINT, payment_method STRING, currency STRING
    """,
    "paypal_transactions": """
        transaction_id STRING, paypal_transaction_id STRING, transaction_event_code STRING,
        transaction_initiation_date STRING, transaction_updated_date STRING,
        transaction_amount STRUCT<currency_code: STRING, value: STRING>, transaction_amount_vnd BIGINT,
        fee_amount STRUCT<currency_code: STRING, value: STRING>, transaction_status STRING,
        transaction_subject STRING, transaction_note STRING,
        payer_info STRUCT<account_id: STRING, email_address: STRING, address_status: STRING,
            payer_status: STRING, payer_name: STRUCT<given_name: STRING, surname: STRING>, country_code: STRING>,
        shipping_info STRUCT<name: STRING, address: STRUCT<line1: STRING, city: STRING, state: STRING,
            postal_code: STRING, country_code: STRING>>,
        transaction_type STRING, payment_tracking_id STRING, invoice_id STRING,
        protection_eligibility STRING, customer_id BIGINT, source STRING
    """,
    "mercury_accounts": """
        id STRING, name STRING, accountNumber STRING, routingNumber STRING, type STRING, status STRING,
        currentBalance DOUBLE, availableBalance DOUBLE, currency STRING, createdAt STRING,
        legalBusinessName STRING, canReceiveTransactions BOOLEAN, canSendDomesticWires BOOLEAN,
        canSendInternationalWires BOOLEAN,
        limits STRUCT<dailyWireLimit: BIGINT, dailyAchLimit: BIGINT, monthlyWireLimit: BIGINT>
    """,
    "mercury_transactions": """
        id STRING, transaction_id STRING, accountId STRING, amount DOUBLE, amount_usd DOUBLE,
        amount_vnd BIGINT, bankDescription STRING, createdAt STRING, postedAt STRING, status STRING,
        kind STRING, note STRING,
        details STRUCT<counterpartyName: STRING, counterpartyRoutingNumber: STRING,
            counterpartyAccountNumber: STRING, wireReference: STRING, achType: STRING, traceNumber: STRING,
            merchantName: STRING, merchantCategory: STRING, cardLast4: STRING, feeType: STRING,
            description: STRING>,
        source STRING
    """,
    "momo_transactions": """
        transaction_id STRING, customer_id BIGINT, source STRING, partnerCode STRING, orderId STRING,
        requestId STRING, amount BIGINT, orderInfo STRING, orderType STRING, transId BIGINT,
        resultCode BIGINT, message STRING, payType STRING, responseTime BIGINT, responseTimeISO STRING,
        extraData STRUCT<store_id: STRING, customer_phone: STRING, customer_name: STRING>,
        signature STRING, payUrl STRING, qrCodeUrl STRING,
        refundTrans ARRAY<STRUCT<orderId: STRING, amount: BIGINT, resultCode: BIGINT, transId: BIGINT,
            createdTime: BIGINT>>,
        promotionInfo ARRAY<STRUCT<promoCode: STRING, promoAmount: BIGINT, promoDescription: STRING>>
    """,
    "zalopay_transactions": """
        transaction_id STRING, customer_id BIGINT, source STRING, return_code BIGINT, return_message STRING,
        sub_return_code BIGINT, sub_return_message STRING, is_processing BOOLEAN, amount BIGINT,
        discount_amount BIGINT, zp_trans_id BIGINT, app_trans_id STRING, app_id BIGINT, app_user STRING,
        app_time BIGINT, server_time BIGINT, server_time_iso STRING, embed_data STRING, item STRING,
        description STRING, channel BIGINT, pmcid BIGINT, bank_code STRING, merchant_user_id STRING,
        callback_url STRING, mac STRING, order_url STRING,
        refund_history ARRAY<STRUCT<refund_id: BIGINT, mrefund_id: STRING, amount: BIGINT, status: BIGINT,
            description: STRING, refund_time: BIGINT>>
    """,
}

ENTITIES = list(_DDL)


def schema(entity: str) -> StructType:
    return StructType.fromDDL(_DDL[entity])
