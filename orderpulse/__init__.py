"""Order analytics on Spark: saga, metering, invoicing, webhooks, tenancy, metrics."""
