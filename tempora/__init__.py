"""Time-state analytics on PySpark: signals, measurements and policies over sparse event logs."""
