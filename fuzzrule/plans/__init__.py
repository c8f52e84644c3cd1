"""End-to-end plans (fit / score), ml wrappers, and the driver query set."""
