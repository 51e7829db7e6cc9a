"""Reading configuration and result files, writing reports."""
