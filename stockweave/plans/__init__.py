"""Jobs composed from operators: calibration, synthesis, forecasting, planning, reporting."""
